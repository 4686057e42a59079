"""Operator 6 passes no table that grows with the texts through the driver."""

from __future__ import annotations

from tillscan.llm import near_dedup
from tillscan.llm.components import components
from tillscan.llm.near_dedup import keep_one_of_each


def _broadcasts(spark, run) -> list[str]:
    """The lines of the plans of ``run``'s jobs that broadcast."""
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    store = spark._jsparkSession.sharedState().statusStore()
    before = store.executionsCount()
    run()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    new = store.executionsList(before, 10_000)
    assert new.size()
    plans = [new.apply(i).physicalPlanDescription() for i in range(new.size())]
    return [line for p in plans for line in p.splitlines() if "BroadcastExchange" in line]


def test_labels_are_not_broadcast(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(20)], "a long, b long")
    assert _broadcasts(spark, lambda: components(edges).collect()) == []


def test_texts_and_clusters_are_not_broadcast(spark):
    words = [f"w{i}" for i in range(60)]
    near = [(k, " ".join([*words[:-1], f"x{k}"])) for k in range(6)]
    df = spark.createDataFrame([*near, (9, "another text"), (10, "another text")], "doc_id long, text string")
    assert _broadcasts(spark, lambda: keep_one_of_each(df).collect()) == []


def test_classes_of_small_and_large_clusters(spark, monkeypatch):
    """Small clusters are tied in their task, large ones by joins; both at once give the same classes."""
    rows = []
    for c, copies in ((0, 2), (1, 3), (2, 9)):
        words = [f"c{c}w{i}" for i in range(60)]
        rows += [(100 * c + k, " ".join([*words[:-1], f"x{k}"])) for k in range(copies)]
    monkeypatch.setattr(near_dedup, "BLOCK_TEXTS", 4)
    df = spark.createDataFrame([*rows, (300, "alone")], "doc_id long, text string")
    got = {(r["doc"], r["class"]) for r in near_dedup.near_classes(df).collect()}
    assert got == {*((d, d // 100 * 100) for d, _ in rows), (300, 300)}
