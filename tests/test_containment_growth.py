"""Joins on dictionaries grow with the tables alone, and leave the driver out."""

from __future__ import annotations

from pyspark.sql import functions as F

from tillscan.operators import containment as C
from tillscan.operators.brands import with_known_brands


def test_look_alikes_cost_no_more_than_finds(spark):
    """Texts that share all 3-grams of many names meet only names that stand in them."""
    n = 2000
    texts = spark.range(n).selectExpr("concat('aguamarca', id, 'fina') AS text")
    patterns = spark.range(n).selectExpr("concat('marca', id) AS pattern")
    looked = C.pieces(texts, patterns)
    # At one place of each text a name may begin, with at most four lengths.
    assert looked.count() <= 4 * n
    found = {(r.text, r.pattern) for r in C.contained(texts, patterns).collect()}
    keys = [str(i) for i in range(n)]
    assert found == {(f"aguamarca{k}fina", f"marca{k[:i]}") for k in keys for i in range(1, len(k) + 1)}


def test_no_dictionary_goes_through_the_driver(spark):
    """Tables that grow with the data are not broadcast, however small they look."""
    rows = spark.range(50).selectExpr("concat('Agua Marca', id) AS t")
    aliases = spark.range(50).selectExpr(
        "int(id) AS pos", "0 AS alias_pos", "concat('Marca', id) AS brand", "concat('marca', id) AS norm", "concat('marca', id) AS compact"
    )
    plan = with_known_brands(rows, aliases, "t", F.lit(True))._jdf.queryExecution().executedPlan().toString()
    joins = [x for x in plan.split("\n") if "BroadcastHashJoin" in x]
    # The 3-grams, the names under three characters and the empty one are bounded.
    growing = [x for x in joins if "gram" not in x and "__all" not in x]
    assert len(growing) <= 1 and all("pattern" in x for x in growing), joins
    assert plan.count("SortMergeJoin") >= 4
