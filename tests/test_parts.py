from __future__ import annotations

import pytest

from tillscan.plans import rendered as R
from tillscan.plans import variants  # noqa: F401  registers its queries
from tillscan.plans.registry import QUERIES

DIR = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["brand_strip", "image_variants", "image_files", "fallback_brand"])
def test_a_small_file_keeps_all_cores_busy(spark, name):
    assert QUERIES[name](spark, DIR).rdd.getNumPartitions() >= 4 * spark.sparkContext.defaultParallelism


def test_rendered_parts_grow_with_the_table(spark, tmp_path):
    """Ten files of one part each, and a fixed number for one."""
    fixed = 4 * spark.sparkContext.defaultParallelism
    assert R.parts_wanted(R.table(spark, DIR, "lineitem")) == fixed
    for i in range(10):
        R.table(spark, DIR, "lineitem").write.parquet(f"{tmp_path}/lineitem.parquet/batch={i}")
    old = spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.openCostInBytes", "134217728")  # files are not put together
    try:
        assert R.parts_wanted(R.table(spark, str(tmp_path), "lineitem")) >= 10 * R.PARTS_EACH > fixed
    finally:
        spark.conf.set("spark.sql.files.openCostInBytes", old)


def test_items_are_moved_by_order_only(spark):
    """Regions are joined to orders before the wide items are, so no exchange by customer moves items."""
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = R.order_items(spark, DIR)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    by_customer = next(i for i, line in enumerate(plan.splitlines()) if "hashpartitioning(o_custkey" in line)
    below = plan.splitlines()[by_customer + 1 :]
    depth = plan.splitlines()[by_customer].index("Exchange")
    own = []
    for line in below:
        if len(line) - len(line.lstrip(" :+-")) <= depth:
            break
        own.append(line)
    assert not any("lineitem" in line or "collect_list" in line for line in own)


def test_boxes_are_merged_into_lines_once(spark):
    """The score of a rendering and its text come from one reading of its boxes."""
    from pyspark.sql import functions as F

    from tillscan.operators.ocr import best_texts

    box = "struct<top:double,left:double,box_no:int,height:double,score:double,text:string>"
    rows = [(1, 0, v, t) for v, t in ((0, "uno"), (0, "dos"), (1, "total 3,00"), (2, "total 3,00"))]
    df = spark.createDataFrame(rows, "receipt_id long, page int, variant_pos int, text string")
    boxes = df.withColumns({"box_no": F.length("text"), "score": F.lit(0.5), "top": F.length("text") * 40.0, "left": F.lit(1.0), "height": F.lit(20.0)})
    assert set(boxes.columns) >= set(spark.createDataFrame([], f"b {box}").select("b.*").columns)
    out = best_texts(boxes)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and plan.count("LogicalRDD") == 1
    assert [tuple(r) for r in out.collect()] == [(1, 0, "total 3,00")]
