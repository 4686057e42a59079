"""Learned brands on a stream: any split into micro-batches gives what the batch query gives."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from tillscan.operators.brands import learned_brands
from tillscan.streaming import brands as B

SCHEMA = "brand string, receipt_id long, line_no int"


@pytest.mark.parametrize("seed", [1, 2])
def test_any_split_equals_the_batch(spark, tmp_path, seed):
    r = random.Random(seed)
    names = ["Zafiro", "ZAFIRO", "Záfiro", "Té Rojo", "te rojo", "X1", "ab", "Almacen", "Sancor", "Lunar  Sol"]
    rows = [(r.choice(names), i // 4, i % 4) for i in range(120)] + [(None, 1, 1)]
    known = spark.createDataFrame([("SANCOR",)], "brand string")
    wanted = learned_brands(spark.createDataFrame(rows, SCHEMA), known, ["receipt_id", "line_no"])
    r.shuffle(rows)  # files can come late
    session = spark.newSession()
    for key, value in (B.STATE | {"spark.sql.shuffle.partitions": "3"}).items():
        session.conf.set(key, value)
    own = session.createDataFrame([("SANCOR",)], "brand string")
    cuts = sorted(r.sample(range(1, len(rows)), 3))
    got: dict[str, str] = {}
    for n, (a, b) in enumerate(zip([0, *cuts], [*cuts, len(rows)], strict=True)):
        spark.createDataFrame(rows[a:b], SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = session.readStream.schema(SCHEMA).parquet(str(tmp_path / "in"))
        seen: list = []
        query = (
            B.stream_learned_brands(stream, own).writeStream.outputMode("update")
            .foreachBatch(lambda df, _, seen=seen: seen.extend(df.collect()))
            .option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
        )
        query.awaitTermination()
        got |= {x.norm: x.brand for x in seen}
    assert got == {x.norm: x.brand for x in wanted.collect()}
    assert set(got) == {"zafiro", "te rojo", "lunar sol"}


def test_a_frequent_name_is_one_row_a_batch(spark):
    df = spark.range(1000).select(F.lit("n").alias("norm"), F.lit("N").alias("brand"), (1000 - F.col("id")).alias("receipt_id"), F.lit(1).alias("line_no"))
    got = df.coalesce(1).mapInArrow(B.first_of_batch, B.NAMES).collect()
    assert [tuple(x) for x in got] == [("n", "N", 1, 1)]
