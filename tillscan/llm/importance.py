"""Operator 12, importance resampling towards a target distribution by hashed n-grams.

A streaming CRC ring reads each document once: it keeps the running zlib states of the runs that
began at the last ``n`` words, extends each by a space and the next word, and emits
the bucket of every state. A text goes through in blocks of ``BLOCK_BYTES``, and the ring carries over, so
a very long text takes a block's memory and its buckets'. Buckets (two bytes
each) are written below ``spark.checkpoint.dir``; corpus counts, gains and weights come from them.

A bucket's gain is the floored thousandfold log ratio of its add-one shares in target and corpus; a
document's weight is the floored mean gain of its features. Drawing without replacement by
weight takes the highest scores: weight plus thousandfold Gumbel noise from a hash of the id.
Counts and gains are tables of ``BUCKETS`` rows whatever the corpus holds; every row counts.

Ranks need no global sort. Scores are whole numbers within some 60,000 of 0, so the
table of counts by score is bounded and gives the rank before each score; within a score rows that
are alike are counted first, then numbered by id, and unfolded again.

Defined cases: null text has no words; a document without features weighs 0; a null id draws
with the hash of the empty id and sorts before all others; rows alike are documents each and get ranks of their
own, next to each other; ties go to the smaller id, then to the smaller weight and count; other columns
play no part; without a target all gains still follow from add-one shares; an empty table stays empty.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bpe import batch_slices
from .common import CRC_SQL, crc_sql, cut, new_folder, table
from .packing import spans

BUCKETS, RUN, MIN_WORDS, SHARE = 10_000, 2, 20, 25
BLOCK_BYTES = 256_000
#: Bytes of words, A-Z lower-cased; all else a blank.
_WORDS = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)
_BREAK = re.compile(rb"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]")


def crc_ring(text: bytes, n: int = RUN) -> Iterator[list[list[int]]]:
    """The CRCs of all runs of 1 to ``n`` words of a text: for each block a list by length."""
    ring: list[list[int]] = [[] for _ in range(n)]  # of each length, the state that ends at the last word
    for a, b in spans(text, BLOCK_BYTES, _BREAK):
        words = text[a:b].translate(_WORDS).split()
        if not words:
            continue
        spaced = [b" " + w for w in words]
        found = [list(map(crc32, words))]
        for k in range(1, n):
            # Each run of k words, extended by the word behind it.
            before = [*ring[k - 1], *found[-1][:-1]]
            ring[k - 1] = found[-1][-1:] or ring[k - 1]
            found.append(list(map(crc32, spaced[len(words) - len(before) :], before)))
        yield found


_SCANNED = [T.StructField("n_words", T.LongType()), T.StructField("n_features", T.LongType()),
            T.StructField("buckets", T.BinaryType())]


def scan(df: DataFrame, id_col: str, text_col: str, n: int = RUN, buckets: int = BUCKETS) -> DataFrame:
    """(id, n_words, n_features, buckets): a map; ``buckets`` packs unsigned 16-bit numbers."""
    if not 0 < buckets <= 2**16:
        raise ValueError("buckets are of 16 bits")
    schema = T.StructType([df.schema[id_col], *_SCANNED])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in batch_slices(whole, text_col):
                counts, packed = [], []
                for t in batch.column(text_col).cast(pa.binary()):
                    n_words, own = 0, []
                    for found in crc_ring(t.as_py() or b"", n):
                        n_words += len(found[0])
                        own += [(np.array(s, np.uint32) % buckets).astype("<u2").tobytes() for s in found]
                    counts.append(n_words)
                    packed.append(b"".join(own))
                made = [
                    pa.array(counts, pa.int64()),
                    pa.array([len(p) // 2 for p in packed], pa.int64()),
                    pa.array(packed, pa.binary()),
                ]
                yield pa.RecordBatch.from_arrays([batch.column(id_col), *made], names=schema.names)

    return df.select(id_col, text_col).mapInArrow(run, schema)


def bucket_counts(scanned: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """How often each bucket occurs: a task hands over one row for each bucket it has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            packed = b"".join(b.as_py() for b in batch.column("buckets"))
            total += np.bincount(np.frombuffer(packed, "<u2"), minlength=buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[some])], names=["bucket", "n"])

    counted = scanned.select("buckets").mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(buckets, np.int64)
    for bucket, n in counted.collect():  # at most ``buckets`` rows
        out[bucket] = n
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """The floored gain of each bucket."""
    k, total, wanted = len(corpus), int(corpus.sum()), int(target.sum())
    return np.array(
        [
            math.floor(1000 * math.log((float(t + 1) * float(total + k)) / (float(s + 1) * float(wanted + k))))
            for s, t in zip(corpus.tolist(), target.tolist(), strict=True)
        ],
        np.int64,
    )


def weights(scanned: DataFrame, gain: np.ndarray, id_col: str) -> DataFrame:
    """(id, n_words, n_features, weight): the floored mean of the gains of a document's features."""
    shared = scanned.sparkSession.sparkContext.broadcast(gain)
    schema = T.StructType([scanned.schema[c] for c in (id_col, "n_words", "n_features")] + [T.StructField("weight", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            found = [np.frombuffer(b.as_py(), "<u2") for b in batch.column("buckets")]
            mean = [int(own[f].sum()) // len(f) if len(f) else 0 for f in found]
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in (id_col, "n_words", "n_features")] + [pa.array(mean, pa.int64())], names=schema.names
            )

    return scanned.mapInArrow(run, schema)


def gumbel(id_col: str, seed: int) -> Column:
    """Floored thousandfold Gumbel noise from the id's hash; below 23,000 either way."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(text.cast("binary"), 256), 1, 8), 16, 10).cast("long")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h.cast("double") + 0.5) / F.lit(4294967296.0))))


def draw(scored: DataFrame, id_col: str, share: int = SHARE, min_words: int = MIN_WORDS) -> DataFrame:
    """``scored`` (id, n_words, n_features, weight, score) with ``rank``: 1 and on for the drawn, else null.

    Of N rows with ``min_words`` words, floor(share * N / 100) are drawn.
    """
    able = scored.filter(F.col("n_words") >= min_words)
    counted = cut(able.groupBy("score").agg(F.count("*").alias("n")), at_most=200_000)
    wanted = share * (counted.agg(F.sum("n")).first()[0] or 0) // 100
    # One row for each score there is, so it is small however many documents there are.
    before = Window.orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, -1)
    above = counted.select("score", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("above"))
    reached = above.filter(F.col("above") < wanted)
    placed = scored.join(F.broadcast(reached), "score", "left")
    in_draw = (F.col("n_words") >= min_words) & F.col("above").isNotNull()
    columns = [id_col, "n_words", "n_features", "weight", "score"]
    rest = placed.filter(~in_draw).select(*columns, F.lit(None).cast("long").alias("rank"))
    alike = placed.filter(in_draw).groupBy(*columns, "above").agg(F.count("*").alias("copies"))
    order = [F.col(id_col).asc_nulls_first(), F.col("weight"), F.col("n_features"), F.col("n_words")]
    earlier = Window.partitionBy("score").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    first = F.col("above") + F.coalesce(F.sum("copies").over(earlier), F.lit(0)) + 1
    ranked = alike.withColumn("first", first).withColumn("at", F.explode(F.sequence("first", F.col("first") + F.col("copies") - 1)))
    return ranked.select(*columns, F.when(F.col("at") <= wanted, F.col("at")).alias("rank")).unionByName(rest)


def resample(
    docs: DataFrame,
    target: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    target_text: str = "text",
    n: int = RUN,
    buckets: int = BUCKETS,
    share: int = SHARE,
    min_words: int = MIN_WORDS,
    seed: int = 7,
) -> DataFrame:
    """Every document's (id, n_words, n_features, weight, score, rank) against ``target``."""
    spark = docs.sparkSession
    stored = f"{new_folder(spark, 'importance')}/buckets"
    scan(docs, id_col, text_col, n, buckets).write.parquet(stored)
    scanned = spark.read.parquet(stored)
    wanted = target.select(F.lit(0).alias("__at"), F.col(target_text).alias("__text"))
    gain = gains(bucket_counts(scanned, buckets), bucket_counts(scan(wanted, "__at", "__text", n, buckets), buckets))
    scored = cut(weights(scanned, gain, id_col).withColumn("score", F.col("weight") + gumbel(id_col, seed)))
    return draw(scored, id_col, share, min_words)


OP12_SQL = f"""
WITH RECURSIVE {CRC_SQL},
texts AS (SELECT 'd' AS side, row_number() OVER () AS row, doc_id, text FROM documents
  UNION ALL SELECT 't', row_number() OVER (), NULL, text FROM benchmark),
lowered AS (
  SELECT side, row, doc_id,
    coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), []) AS w
  FROM texts
),
runs AS (
  SELECT side, row, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS f FROM lowered
),
buckets AS (SELECT f, {crc_sql("f")} % 10000 AS bucket FROM (SELECT DISTINCT f FROM runs), crc_table),
features AS (SELECT side, row, bucket, count(*) AS n FROM runs JOIN buckets USING (f) GROUP BY ALL),
sums AS (
  SELECT bucket, coalesce(sum(n) FILTER (WHERE side = 'd'), 0) AS s, coalesce(sum(n) FILTER (WHERE side = 't'), 0) AS t
  FROM features GROUP BY bucket
),
totals AS (SELECT coalesce(sum(s), 0)::DOUBLE AS whole_s, coalesce(sum(t), 0)::DOUBLE AS whole_t FROM sums),
gained AS (
  SELECT bucket, floor(1000 * ln(((t + 1)::DOUBLE * (whole_s + 10000)) / ((s + 1)::DOUBLE * (whole_t + 10000))))::BIGINT AS gain
  FROM sums, totals
),
weighed AS (SELECT row, sum(n) AS n_features, sum(n * gain) AS total FROM features JOIN gained USING (bucket) WHERE side = 'd' GROUP BY row),
scored AS (
  SELECT l.row, doc_id, len(w) AS n_words, coalesce(n_features, 0)::BIGINT AS n_features,
    coalesce(floor(total::DOUBLE / n_features), 0)::BIGINT AS weight,
    ('0x' || substr(sha256('7:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT AS h
  FROM lowered l LEFT JOIN weighed USING (row) WHERE side = 'd'
),
noisy AS (SELECT *, weight + floor(-1000 * ln(-ln((h + 0.5) / 4294967296::DOUBLE)))::BIGINT AS score FROM scored),
ranked AS (
  SELECT row, row_number() OVER (ORDER BY score DESC, doc_id NULLS FIRST, weight, n_features, n_words) AS r, count(*) OVER () AS n
  FROM noisy WHERE n_words >= 20
)
SELECT doc_id, n_features, weight, score, CASE WHEN r <= 25 * n // 100 THEN r END::BIGINT AS rank
FROM noisy LEFT JOIN ranked USING (row)
"""


def op12_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, target = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    drawn = resample(docs.select("doc_id", "text"), target.select("text"))
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")
