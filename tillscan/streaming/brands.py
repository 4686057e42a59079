"""A stream of learned brands: each name once, in its first spelling, across micro-batches.

State is keyed by the name's normal form: the spelling and where it stands. A row that stands earlier
than what is known (files can come late) replaces it, so how receipts are split into
micro-batches decides nothing. Each change is a row of the stream; the last one of a name holds.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

from tillscan.functions.text import clean_brand, dict_norm
from tillscan.operators.brands import can_learn

NAMES = "norm string, brand string, receipt_id long, line_no int"
_NAME = Row(*(f.split()[0] for f in NAMES.split(", ")))
#: What the stream needs of its session.
STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
}


def first_of_batch(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The first row of each name in a batch: a frequent name is a row for each batch, not each line."""
    for batch in batches:
        rows = pa.Table.from_batches([batch]).sort_by([(c, "ascending") for c in ("receipt_id", "line_no", "brand")])
        number = pa.array(range(rows.num_rows), pa.int64())
        least = rows.append_column("i", number).group_by("norm", use_threads=False).aggregate([("i", "min")])
        yield from rows.take(least.column("i_min")).to_batches()


class FirstSpelling(StatefulProcessor):
    """The least (receipt_id, line_no, brand) of a name so far."""

    def init(self, handle) -> None:
        self.known = handle.getValueState("known", "brand string, receipt_id long, line_no int")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        known = self.known.get()
        before = (known[1], known[2], known[0]) if known else None
        least = min((r.receipt_id, r.line_no, r.brand) for r in rows)
        if before is None or least < before:
            self.known.update((least[2], least[0], least[1]))
            yield _NAME(key[0], least[2], least[0], least[1])


def stream_learned_brands(items: DataFrame, known: DataFrame) -> DataFrame:
    """(norm, brand, receipt_id, line_no): changes of learned names, from a stream of
    (brand, receipt_id, line_no); names of ``known`` (brand), a plain table, are left out (A4, J8, P13).

    Needs the session settings of ``STATE``, and output mode ``update``.
    """
    rows = items.filter(can_learn(F.col("brand"))).select(
        dict_norm(F.col("brand")).alias("norm"), clean_brand(F.col("brand")).alias("brand"),
        F.col("receipt_id").cast("long").alias("receipt_id"), F.col("line_no").cast("int").alias("line_no"),
    )
    have = known.select(dict_norm(F.col("brand")).alias("norm")).distinct()
    new = rows.join(have, "norm", "left_anti").select("norm", "brand", "receipt_id", "line_no")
    return new.mapInArrow(first_of_batch, NAMES).groupBy("norm").transformWithState(
        FirstSpelling(), T.StructType.fromDDL(NAMES), "update", "None"
    )
