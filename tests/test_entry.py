"""The driver's contract, also without the training-data subpackage."""

from __future__ import annotations

import re
import shutil
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from tillscan.plans import registry

ROOT = Path(__file__).resolve().parent.parent
SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
TABLES += " clicks client_changes clients items sale_lines sales stamps vendors"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES.split():
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def plain(v):
    return round(v, 6) if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(set(entry.queries()) & set(entry.oracle_sql())))
def test_query_equals_sql(spark, con, name):
    df = entry.queries()[name](spark, SF)
    cols = sorted(df.columns)
    found = con.execute(entry.oracle_sql()[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == cols
    want = [tuple(plain(r[names.index(c)]) for c in cols) for r in found.fetchall()]
    got = [tuple(plain(r[c]) for c in cols) for r in df.collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, want)) and got


def test_every_receipt_query_has_sql():
    assert set(registry.QUERIES) == set(registry.SQL)


def test_entry(spark):
    df = entry.entry(spark)
    assert df.count() > 0 and df.schema == entry.entry(spark).schema


def test_runs_without_the_subpackage(tmp_path):
    shutil.copytree(ROOT / "tillscan", tmp_path / "tillscan", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'receipt_items' in q and 'pipeline' not in q and set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)})


def test_nothing_else_imports_the_subpackage():
    for p in (ROOT / "tillscan").rglob("*.py"):
        if "llm" not in p.parts:
            assert not re.search(r"\bllm\b", p.read_text(encoding="utf-8")), p
