"""Connected components: the library's own."""

from ..operators.components import components

__all__ = ["components"]
