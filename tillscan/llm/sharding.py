"""Operator 1, sharding by balanced label propagation: joins and aggregates only.

Documents are linked if their texts are equal. Every linked document starts with the label
(shard) of its hash. In each round a group looks at the counts of its labels, and members
with another label ask to move to the most frequent one. A shard takes in what its quota
leaves room for, what leaves it included, the largest gains first: the demand by shards and
gain class is summed, full classes are let in whole and the class on the border by a hashed
share, so no sort of the demand is needed. Members of one group with one label are alike, so a round works on
one row for each (group, label), however many documents that is. A group that no single
shard can hold is split into chunks of at most a shard by hash before anything else.

After the rounds the sizes are made exact. Documents are ranked within their shard; those
beyond the shard's share, and all documents without links, fill the gaps that are left, by
rank. Moving a document without links cuts nothing. Ranks come from two levels (a row
number within a bucket of bounded size, plus the prefix sum of bucket counts).

The law is ``rows``: counts of any two shards differ by one at most. ``slot`` is the rank
within the shard, from 0 without gaps.

Defined cases: null text has 16 bytes of size and the checksum of the empty text, and
counts as equal to it; a null id sorts first and returns as null; repeated rows are
documents of their own with equal text; fewer documents than shards leave the last shards
empty; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, hash128, id_or_least, table

#: Rows that are ranked in one task.
BUCKET_ROWS = 20_000
_LEAST = -(2**63)


def _pick(values: list[int], at: Column) -> Column:
    return F.get(F.array(*[F.lit(v).cast("long") for v in values]), at)


def _admit(wanted: list[tuple[int, int]], left: float) -> tuple[int, float]:
    """The least gain class of (gain, n) let in whole, and the share of the class below."""
    whole = 64
    for gain, n in sorted(wanted, reverse=True):
        if n > left:
            return gain + 1, left / n
        left, whole = left - n, gain
    return whole, 0.0


def _gates(demand: list, room: list[int]) -> list[tuple[int, float]]:
    """Gates of all shards, when what leaves a shard makes room in it too.

    What leaves depends on the other gates, so they are settled in a few turns.
    """
    shards = range(len(room))
    out = [0.0] * len(room)
    gates: list[tuple[int, float]] = []
    for _ in range(12):
        wanted: list[dict[int, int]] = [{} for _ in shards]
        for r in demand:
            wanted[r.target][r.gain] = wanted[r.target].get(r.gain, 0) + r.n
        gates = [_admit(list(wanted[t].items()), room[t] + out[t]) for t in shards]
        out = [0.0] * len(room)
        for r in demand:
            whole, share = gates[r.target]
            out[r.shard] += r.n * (1.0 if r.gain >= whole else share if r.gain == whole - 1 else 0.0)
    return gates


def propagate(state: DataFrame, shards: int, quota: int, rounds: int, at_most: int) -> DataFrame:
    """Rounds of balanced label propagation over (g, shard, n), of ``at_most`` rows."""
    own = Window.partitionBy("g")
    for turn in range(rounds):
        # At most one row for each shard here, and one for each two shards and power of two below.
        loads = {r.shard: r.n for r in state.groupBy("shard").agg(F.sum("n").alias("n")).collect()}
        room = [max(0, quota - loads.get(t, 0)) for t in range(shards)]
        # Count, then a hash that breaks ties, then the label. In every second round labels
        # whose shard has room come first, so that groups whose favourite is full meet elsewhere.
        free = _pick(room, F.col("shard")) > 0 if turn % 2 else F.lit(False)
        tie = F.xxhash64("g", "shard", F.lit(turn))
        best = F.struct(free.alias("free"), F.col("n").alias("count"), tie.alias("tie"), F.col("shard").alias("target"))
        voted = state.withColumn("top", F.max(best).over(own)).select(
            "g", "shard", "n", F.col("top.target").alias("target"),
            F.floor(F.log2(F.col("top.count").cast("double"))).cast("int").alias("gain"),
        )
        demand = voted.filter("shard <> target").groupBy("target", "shard", "gain").agg(F.sum("n").alias("n")).collect()
        gates = _gates(demand, room)
        whole = _pick([g[0] for g in gates], F.col("target"))
        share = F.get(F.array(*[F.lit(g[1]) for g in gates]), F.col("target"))
        chance = F.pmod(F.xxhash64("g", "shard", F.lit(turn)), F.lit(1 << 20)) / float(1 << 20)
        moves = (F.col("gain") >= whole) | ((F.col("gain") == whole - 1) & (chance < share))
        state = cut(
            voted.withColumn("shard", F.when(moves, F.col("target")).otherwise(F.col("shard")))
            .groupBy("g", "shard")
            .agg(F.sum("n").alias("n")),
            at_most,
        )
    return state


def _ranked(df: DataFrame, by: list[str], bucket: Column, order: list[str]) -> DataFrame:
    """``df`` with ``rank`` (from 0) within each value of ``by`` (all rows if empty)."""
    df = df.withColumn("__b", bucket)
    inner = Window.partitionBy(*by, "__b").orderBy(*order)
    sums = Window.partitionBy(*by).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    before = (
        df.groupBy(*by, "__b").agg(F.count("*").alias("__n"))
        .select(*by, "__b", F.coalesce(F.sum("__n").over(sums), F.lit(0)).alias("__before"))
    )
    ranked = df.withColumn("__r", F.row_number().over(inner) - 1).join(before, [*by, "__b"])
    return ranked.withColumn("rank", F.col("__r") + F.col("__before")).drop("__b", "__r", "__before")


def shard_documents(
    df: DataFrame, shards: int = 40, rounds: int = 4, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot, g) for every row; ``g`` is the group of equal
    texts (or the chunk of one beyond a shard) a document belongs to, null without links."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    h1, h2 = hash128(text)
    rows = df.select(
        id_or_least(F.col(id_col)).alias("doc"),
        (F.octet_length(text) + 16).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("crc"),
        h1.alias("h1"),
        h2.alias("h2"),
    )
    rows = cut(rows)
    total = rows.count()
    quota, over = divmod(total, shards)
    chunk = max(2, quota)
    groups = rows.groupBy("h1", "h2").agg(F.count("*").alias("n")).filter("n > 1")
    groups = groups.select("h1", "h2", F.ceil(F.col("n") / chunk).alias("parts"))
    part = F.pmod(F.xxhash64("doc"), F.col("parts"))
    marked = cut(
        rows.join(groups, ["h1", "h2"], "left").select(
            "doc", "size", "crc", F.when(F.col("parts").isNotNull(), F.xxhash64("h1", "h2", part)).alias("g")
        ),
        total,
    )
    linked = marked.filter("g IS NOT NULL")
    start = F.pmod(F.xxhash64("doc", F.lit("shard")), F.lit(shards)).cast("int")
    state = cut(linked.groupBy("g", start.alias("shard")).agg(F.count("*").alias("n")), total)
    state = propagate(state, shards, quota, rounds, total)

    # Members take the labels of their group in order; a group has at most ``shards`` labels.
    upto = Window.partitionBy("g").orderBy("shard")
    spans = (
        state.withColumn("upto", F.sum("n").over(upto))
        .groupBy("g").agg(F.sort_array(F.collect_list(F.struct("upto", "shard"))).alias("spans"))
    )
    many = F.pmod(F.xxhash64("doc", F.lit("member")), F.lit(1 + total // BUCKET_ROWS))
    placed = (
        _ranked(linked, ["g"], many, ["doc", "size", "crc"])
        .join(spans, "g")
        .withColumn("shard", F.get(F.filter("spans", lambda s: s["upto"] > F.col("rank")), 0)["shard"])
        .select("doc", "size", "crc", "g", "shard")
    )
    share = [quota + (s < over) for s in range(shards)]
    buckets = 1 + total // (shards * BUCKET_ROWS)
    placed = cut(_ranked(placed, ["shard"], F.pmod(F.xxhash64("g", "doc"), F.lit(buckets)), ["g", "doc", "size", "crc"]), total)
    fits = F.col("rank") < _pick(share, F.col("shard"))
    loads = {r.shard: r.n for r in placed.filter(fits).groupBy("shard").agg(F.count("*").alias("n")).collect()}
    kept = [loads.get(s, 0) for s in range(shards)]
    ends = list(accumulate(a - b for a, b in zip(share, kept, strict=True)))
    pool = placed.filter(~fits).select("doc", "size", "crc", "g").unionByName(marked.filter("g IS NULL"))
    spread = F.pmod(F.xxhash64("doc", "size", "crc"), F.lit(1 + total // BUCKET_ROWS))
    pool = _ranked(pool, [], spread, ["doc", "size", "crc"])
    gap = F.size(F.filter(F.array(*[F.lit(e).cast("long") for e in ends]), lambda e: e <= F.col("rank")))
    filled = pool.withColumn("shard", gap).select(
        "doc", "size", "crc", "g", "shard",
        (F.col("rank") - _pick([0, *ends[:-1]], F.col("shard")) + _pick(kept, F.col("shard"))).alias("slot"),
    )
    out = placed.filter(fits).select("doc", "size", "crc", "g", "shard", F.col("rank").alias("slot"))
    return out.unionByName(filled).select(
        F.when(F.col("doc") != _LEAST, F.col("doc")).alias("doc_id"),
        "size", F.col("crc").alias("text_crc32"),
        F.col("shard").cast("int").alias("shard"), F.col("slot").cast("long").alias("slot"), "g",
    )


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return shard_documents(docs).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
