from __future__ import annotations

import ast
from pathlib import Path

import pytest

import __spark_entry__ as entry

ROOT = Path(__file__).resolve().parent.parent
SMALLEST = "/root/testdata/sf0.001"


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_nothing_imports_the_optional_subpackage():
    for p in (ROOT / "docketry").rglob("*.py"):
        if "llm" in p.relative_to(ROOT / "docketry").parts:
            continue
        for node in ast.walk(ast.parse(p.read_text())):
            names = [a.name for a in node.names] if isinstance(node, ast.Import) else [node.module or ""] if isinstance(node, ast.ImportFrom) else []
            assert not any(n.startswith("docketry.llm") for n in names), p


@pytest.mark.skipif(not Path(SMALLEST).exists(), reason="no test tables")
def test_entry_has_rows(spark):
    df = entry.entry(spark)
    assert df.columns == ["tbl", "field", "month", "n_refs", "n_orphans"] and df.count() > 0
