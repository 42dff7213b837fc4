"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from importlib import import_module

MODULES = ("url_reputation", "substring_dedup", "token_counts", "toxicity", "mixing", "packing", "ngram_join", "quality_divergence", "warc", "topk", "hardneg", "fingerprints", "periodic")


def _gathered(name: str) -> dict:
    return {k: v for module in MODULES for k, v in getattr(import_module(f"{__package__}.{module}"), name, {}).items()}


def queries() -> dict:
    return _gathered("QUERIES")


def oracle_sql() -> dict:
    return _gathered("SQL")
