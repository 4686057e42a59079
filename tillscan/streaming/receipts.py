"""Receipts as a stream of text files."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tillscan.operators.items import receipt_items
from tillscan.plans.parse import parse


def text_stream(spark: SparkSession, path: str, files_per_batch: int = 1000) -> DataFrame:
    """(receipt_id, raw_text) of the files that arrive under ``path``."""
    files = (
        spark.readStream.format("text").option("wholetext", True)
        .option("maxFilesPerTrigger", files_per_batch).load(path)
    )
    return files.select(F.col("_metadata.file_path").alias("receipt_id"), F.col("value").alias("raw_text"))


def item_stream(receipts: DataFrame, as_of_year: int) -> DataFrame:
    """Items of a stream of receipts: the batch plan, which has no shuffle and no state."""
    return receipt_items(receipts, as_of_year)


def write_responses(
    receipts: DataFrame, as_of_year: int, checkpoint: str, sink: Callable[[DataFrame, int], None]
) -> StreamingQuery:
    """Parse each micro-batch as a whole; ``sink`` gets (responses, batch id), so it can be idempotent."""

    def write(batch: DataFrame, number: int) -> None:
        sink(parse(batch, as_of_year), number)

    return (
        receipts.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )
