"""Operator 6 on rows that repeat both id and text, in numbers beyond a block."""

from __future__ import annotations

import pytest

from tillscan.llm import near_dedup
from tillscan.llm.near_dedup import keep_one_of_each, near_classes

WORDS = [f"w{i}" for i in range(60)]
TEXT, NEAR, OTHER = " ".join(WORDS), " ".join([*WORDS[:-1], "x"]), " ".join(reversed(WORDS))


@pytest.mark.parametrize("repeated", [None, 3])
def test_repeated_rows_fill_no_block(spark, monkeypatch, repeated):
    def never(*_):
        raise AssertionError("two different texts are no large cluster")

    monkeypatch.setattr(near_dedup, "_large_links", never)
    rows = [(repeated, TEXT)] * (near_dedup.BLOCK_TEXTS + 500) + [(7, NEAR), (8, OTHER), (9, NEAR)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(16)
    least = -(2**63) if repeated is None else repeated
    got = {(r["doc"], r["class"]) for r in near_classes(df).collect()}
    assert got == {(least, least), (7, least), (9, least), (8, 8)}
    kept = [(r.doc_id, r.text) for r in keep_one_of_each(df).collect()]
    assert sorted(kept, key=str) == sorted([(repeated, TEXT), (8, OTHER)], key=str)


def test_repeated_rows_are_one_in_a_large_cluster(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "BLOCK_TEXTS", 2)
    rows = [(None, TEXT)] * 50 + [(5, NEAR), (6, " ".join(["y", *WORDS[1:]])), (8, OTHER)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
    assert {(r["doc"], r["class"]) for r in near_classes(df).collect()} == {
        (-(2**63), -(2**63)), (5, -(2**63)), (6, -(2**63)), (8, 8)
    }


def test_reading_order_decides_nothing(spark):
    """Of rows alike in id and text the least by the other columns stays, however rows are dealt."""
    text = " ".join(f"w{i}" for i in range(60))
    rows = [(3, text, "b", 1), (3, text, "a", 2), (3, text, None, 5), (3, text, "a", 1), (8, text + " more", "a", 0)]
    rows += [(None, None, "z", 1), (None, None, "z", 1), (None, "", "a", 1), (9, "alone here", "q", None)]
    found = set()
    for seed in range(4):
        order = sorted(rows, key=lambda r: hash((seed, str(r))))
        df = spark.createDataFrame(order, "doc_id long, text string, source string, n long").repartition(1 + seed)
        found.add(tuple(sorted(map(str, near_dedup.keep_one_of_each(df, weight="count").collect()))))
    assert len(found) == 1
    kept = {(r.doc_id, r.text, r.source, r.n) for r in near_dedup.keep_one_of_each(df, weight="count").collect()}
    assert kept == {(3, text, None, 5), (None, "", "a", 1), (9, "alone here", "q", None)}
