"""The entry with and without the corpus operators."""

from __future__ import annotations

import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent
BLOCK = """
import sys
class Block:
    def find_spec(self, name, path=None, target=None):
        if name.startswith("stratavox.llm") or name == "corpus_pipeline":
            raise ModuleNotFoundError(name, name=name)
sys.meta_path.insert(0, Block())
"""


def names(prelude: str) -> list[str]:
    code = prelude + "\nimport __spark_entry__ as e\nprint(*sorted(e.queries()))\nassert set(e.oracle_sql()) <= set(e.queries())"
    return subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True, check=True).stdout.split()


def test_entry_imports_without_the_corpus_operators():
    core = names(BLOCK)
    assert "dice_by_label" in core and not any(n.startswith("op") and n[2].isdigit() for n in core)


def test_entry_has_a_smoke_query(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 75
