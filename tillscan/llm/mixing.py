"""Operator 7, mixing sources to target weights by cube-method balanced sampling.

Sources share all words by weight; a source whose share would exceed ``max_repeats`` times
its size stops there, and the excess is shared again by weight (water filling, computed in
closed form over one row for each source). The ratio of target to size gives every
document of a source the same whole number of copies plus a fraction, its inclusion
probability for one copy more.

The cube method decides the fractions. In the flight, three undecided documents move along
the vector that changes neither the expected number of documents nor that of words (the
null space of both constraints) until one of them is at 0 or 1; the direction is drawn so
that probabilities are kept. Flights run in parallel over buckets of at most about
``BUCKET_ROWS`` documents of a source; each leaves two undecided at most, and these meet in
the next level, until one bucket for each source is left. There the landing rounds the last
two to the nearest number of words, then changes places between a taken and another
document of this bucket, at most ``SWAPS`` times, where that comes nearer: the number of
documents stays as the cube has balanced it, within one of what was expected. Directions
come from a generator seeded by the bucket, and documents are ordered by hash and id, so
reruns agree.

Rows alike in everything are one unit with a number of rows: of ``m`` rows with probability
``p``, ``floor(m p)`` are taken for certain and the rest of ``m p`` flies. So a bucket holds
as many rows as any other, however often a row repeats.

Defined cases: null text has no words; the null source sorts last; a source without words
has target 0 and takes nothing; null ids are documents; repeated rows are documents of
their own; extra columns are ignored by ``mix_sizes`` and kept by ``mix_documents``; an
empty table gives an empty result.
"""

from __future__ import annotations

import random
from bisect import bisect_left
from itertools import product

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, cut, table

BUCKET_ROWS = 4000
#: Changes of places after the landing, and rows alike that one row is spread to at a time.
SWAPS, SPREAD = 2, 10_000
#: Sources up to this number (one small row each) are broadcast; more are joined.
BROADCAST_SOURCES = 10_000
_EPS = 1e-9


def source_targets(sources: DataFrame, weights: int = 3, max_repeats: int = 3) -> DataFrame:
    """(source, source_size, n, target) from (source, source_size, n): one row a source."""
    named = Window.orderBy(F.col("source").asc_nulls_last())
    ranked = sources.withColumn("weight", (F.row_number().over(named) - 1) % weights + 1)
    ranked = ranked.withColumn("cap", F.col("source_size") * max_repeats)
    everything = Window.partitionBy()
    fill = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = fill.rowsBetween(Window.unboundedPreceding, -1)
    total, weight = F.sum("source_size").over(everything), F.sum("weight").over(everything)
    level = (total - F.coalesce(F.sum("cap").over(before), F.lit(0))) / (
        weight - F.coalesce(F.sum("weight").over(before), F.lit(0))
    )
    capped = ranked.withColumns({"total": total, "all_weight": weight, "level": level}).withColumn(
        "full", F.col("cap") / F.col("weight") <= F.col("level")
    )
    used = F.sum(F.when(F.col("full"), F.col("cap")).otherwise(0)).over(everything)
    taken = F.sum(F.when(F.col("full"), F.col("weight")).otherwise(0)).over(everything)
    capped = capped.withColumns({"used": used, "taken": taken})
    rest = F.col("weight") * (F.col("total") - F.col("used")) / (F.col("all_weight") - F.col("taken"))
    target = F.when(F.col("full"), F.col("cap").cast("double")).otherwise(rest.cast("double"))
    return capped.select("source", "source_size", "n", target.alias("target"))


def flight(p: list[float], size: list[int], draw: random.Random) -> list[int]:
    """Move ``p`` in place until at most two lie between 0 and 1; those are returned.

    The sums of ``p`` and of ``p * size`` do not change.
    """
    active: list[int] = []
    for i in range(len(p)):
        if not _EPS < p[i] < 1 - _EPS:
            p[i] = float(round(p[i]))
            continue
        active.append(i)
        if len(active) == 3:
            a, b, c = active
            u = [size[c] - size[b], size[a] - size[c], size[b] - size[a]]
            if not any(u):
                u = [1, -1, 0]
            _step(p, active, u, draw)
            active = [j for j in active if 0 < p[j] < 1]
    return active


def _step(p: list[float], at: list[int], u: list[int], draw: random.Random) -> None:
    ahead = back = float("inf")
    for i, v in zip(at, u, strict=True):
        if v:
            up, down = (1 - p[i]) / abs(v), p[i] / abs(v)
            ahead, back = (min(ahead, up), min(back, down)) if v > 0 else (min(ahead, down), min(back, up))
    by = ahead if draw.random() * (ahead + back) < back else -back
    for i, v in zip(at, u, strict=True):
        q = p[i] + by * v
        p[i] = 0.0 if q < _EPS else 1.0 if q > 1 - _EPS else q


def land(p: list[float], size: list[int], left: list[int], wanted: float) -> None:
    """Round the last documents so that the words come nearest to ``wanted``; then swaps."""
    done = sum(s for x, s in zip(p, size, strict=True) if x == 1.0)
    if left:
        # As many documents as were expected, up to rounding.
        expected = sum(p[i] for i in left)
        counts = {int(expected + _EPS), int(expected + 1 - _EPS)}
        choices = [c for c in product((0.0, 1.0), repeat=len(left)) if sum(c) in counts]
        best = min(choices, key=lambda c: (abs(done + sum(x * size[i] for x, i in zip(c, left, strict=True)) - wanted), c))
        for x, i in zip(best, left, strict=True):
            p[i] = x
        done += sum(int(x) * size[i] for x, i in zip(best, left, strict=True))
    for _ in range(SWAPS):
        swap = _swap(p, size, wanted - done)
        if swap is None:
            return
        out, into = swap
        p[out], p[into] = 0.0, 1.0
        done += size[into] - size[out]


def _swap(p: list[float], size: list[int], gap: float) -> tuple[int, int] | None:
    """A taken document and another whose change of places brings ``gap`` nearest to 0."""
    others = sorted((size[i], i) for i in range(len(p)) if p[i] == 0.0)
    best: tuple[float, int, int] | None = None
    for out in range(len(p)):
        if p[out] == 1.0 and others:
            near = bisect_left(others, (size[out] + gap, -1))
            for s, into in others[max(0, near - 1) : near + 1]:
                found = (abs(gap - (s - size[out])), out, into)
                best = found if best is None or found < best else best
    return None if best is None or best[0] >= abs(gap) else (best[1], best[2])


def _decide(last: bool):
    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["order", "doc", "row", "size"], kind="stable", na_position="first")
        p, size = rows["p"].tolist(), rows["size"].tolist()
        draw = random.Random(f"{key[0]} {key[1]}")
        wanted = sum(x * s for x, s in zip(p, size, strict=True))
        left = flight(p, size, draw)
        if last:
            land(p, size, left, wanted)
        return rows.assign(p=p)

    return run


def mix_units(rows: DataFrame, weights: int = 3, max_repeats: int = 3) -> DataFrame:
    """(doc, row, size, source_size, target, m, base, more) from (doc, row, source, size):
    of ``m`` rows alike each is taken ``base`` times, and ``more`` of them once more."""
    units = cut(rows.groupBy("doc", "row", "source", "size").agg(F.count("*").alias("m")))
    total = units.count()
    sources = cut(
        source_targets(
            units.groupBy("source").agg(F.sum(F.col("size") * F.col("m")).alias("source_size"), F.count("*").alias("n")),
            weights, max_repeats,
        ).withColumn("sid", F.xxhash64(F.col("source"), F.col("source").isNull())),
        total,
    )
    seen = sources.agg(F.count("*").alias("k"), F.max("n").alias("n")).first()
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    facts = sources.select(
        F.col("source").alias("__source"), "sid", "source_size", "target", "n",
        F.floor(ratio + _EPS).cast("int").alias("base"),
        F.greatest(F.lit(0.0), ratio - F.floor(ratio + _EPS)).alias("each"),
    )
    facts = F.broadcast(facts) if seen.k <= BROADCAST_SOURCES else facts
    wanted = F.col("m") * F.col("each")
    certain = F.floor(wanted + _EPS)
    units = units.join(facts, F.col("source").eqNullSafe(F.col("__source"))).select(
        "doc", "row", "size", "m", "sid", "n", "source_size", "target", "base", certain.alias("certain"),
        F.greatest(F.lit(0.0), wanted - certain).alias("p"), F.xxhash64("doc", "row", "size").alias("order"),
    )
    sure = units.filter(F.col("p") <= _EPS)
    open_ = units.filter(F.col("p") > _EPS)
    done = [sure.withColumn("p", F.lit(0.0))]
    most, level = int(seen.n or 0), 0
    while True:
        last = most <= BUCKET_ROWS
        bucket = F.lit(0) if last else F.pmod(F.xxhash64("order", F.lit(level)), F.ceil(F.col("n") / BUCKET_ROWS))
        flown = (
            open_.withColumn("bucket", bucket.cast("long"))
            .groupBy("sid", "bucket")
            .applyInPandas(_decide(last), open_.withColumn("bucket", F.lit(0).cast("long")).schema)
            .drop("bucket")
        )
        if last:
            done.append(flown)
            break
        flown = cut(flown)
        done.append(flown.filter("p = 0 OR p = 1"))
        # Two of each bucket are left at most.
        open_ = flown.filter("p > 0 AND p < 1").withColumn("n", 2 * F.ceil(F.col("n") / BUCKET_ROWS))
        most, level = 2 * -(-most // BUCKET_ROWS), level + 1
    out = done[0].drop("n")
    for part in done[1:]:
        out = out.unionByName(part.drop("n"))
    return out.select(
        "doc", "row", "size", "source_size", "target", "m", "base", (F.col("certain") + F.col("p").cast("long")).alias("more")
    )


def mix_sizes(rows: DataFrame, weights: int = 3, max_repeats: int = 3) -> DataFrame:
    """(doc, row, size, source_size, target, copies) from (doc, row, source, size).

    ``row`` is any long that tells rows of one doc apart; rows alike in all four columns are
    exchangeable.
    """
    units = mix_units(rows, weights, max_repeats)
    parts = units.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("m") - 1) / SPREAD))))
    begin, end = F.col("part") * SPREAD, F.least(F.col("m"), (F.col("part") + 1) * SPREAD)
    rows = parts.withColumn("k", F.explode(F.sequence(begin, end - 1)))
    copies = (F.col("base") + (F.col("k") < F.col("more")).cast("int")).cast("int")
    return rows.select("doc", "row", "size", "source_size", "target", copies.alias("copies"))


def _rows(df: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    words = F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long")
    row = F.xxhash64(*[F.col(c) for c in df.columns])
    return df.select(
        F.col(id_col).cast("long").alias("doc"), row.alias("row"), F.col(source_col).alias("source"), words.alias("size")
    )


def mix_documents(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source"
) -> DataFrame:
    """The mix itself: every row of ``df`` as often as it is taken."""
    units = mix_units(_rows(df, id_col, text_col, source_col))
    taken = units.select(
        F.col("doc").alias("__taken_doc"), F.col("row").alias("__taken_row"),
        (F.col("m") * F.col("base") + F.col("more")).alias("__copies"),
    ).filter("__copies > 0")
    keyed = df.withColumns(
        {"__doc": F.col(id_col).cast("long"), "__row": F.xxhash64(*[F.col(c) for c in df.columns])}
    )
    # Rows alike in every column are one row here, as they are one unit above.
    keyed = keyed.dropDuplicates(["__row", "__doc"])
    same = F.col("__row").eqNullSafe(F.col("__taken_row")) & F.col("__doc").eqNullSafe(F.col("__taken_doc"))
    return (
        keyed.join(taken, same)
        .withColumn("__part", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("__copies") - 1) / SPREAD))))
        .withColumn("__copy", F.explode(F.array_repeat(F.lit(0), F.least(F.lit(SPREAD), F.col("__copies") - F.col("__part") * SPREAD).cast("int"))))
        .select(*df.columns)
    )


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mix_sizes(_rows(docs, "doc_id", "text", "source")).select(
        F.col("doc").alias("doc_id"), "size", "source_size", "target",
        (F.col("size") * F.col("copies")).alias("taken"),
    )
