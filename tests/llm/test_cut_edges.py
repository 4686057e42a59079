"""Operator 1: cut edges against simple references."""

from __future__ import annotations

from collections import Counter, defaultdict

from pyspark.sql import functions as F

from tillscan.llm.sharding import shard_documents


def cut_edges(pairs):
    """Edges between equal texts that lie in two shards, of (text, shard)."""
    groups = defaultdict(Counter)
    for text, shard in pairs:
        groups[text][shard] += 1
    return sum((sum(c.values()) ** 2 - sum(n * n for n in c.values())) // 2 for c in groups.values())


def greedy(sizes, quota, shards):
    """Whole groups, the largest first, into the shard with most room; a plain reference."""
    room, cut = [quota] * shards, 0
    for n in sorted(sizes, reverse=True):
        parts, left = [], n
        while left:
            s = max(range(shards), key=lambda i: room[i])
            take = min(left, room[s])
            room[s] -= take
            left -= take
            parts.append(take)
        cut += (n * n - sum(p * p for p in parts)) // 2
    return cut


def test_a_group_that_fits_lies_in_one_shard(spark):
    """Groups of four and of seven tenths of a shard."""
    rows = spark.range(20_000).select(
        F.col("id").alias("doc_id"),
        F.when(F.col("id") < 400, "four tenths").when(F.col("id") < 1100, "seven tenths").otherwise(F.concat(F.lit("own "), "id")).alias("text"),
    )
    out = shard_documents(rows, shards=20)
    found = out.filter("g IS NOT NULL").groupBy("text_crc32").agg(F.count_distinct("shard").alias("n")).collect()
    assert [r.n for r in found] == [1, 1]


def test_cut_edges_near_the_greedy_reference(spark):
    sizes = [900, 300, 300, 120, 80, 80, 40, *[9] * 30, *[2] * 300]
    texts = [f"t{g}" for g, n in enumerate(sizes) for _ in range(n)]
    texts += [f"own {i}" for i in range(6000 - len(texts))]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out = shard_documents(df, shards=6).select("doc_id", "shard").collect()
    ours = cut_edges((texts[r.doc_id], r.shard) for r in out)
    hashed = cut_edges((texts[r.doc_id], hash((r.doc_id, 1)) % 6) for r in out)
    total = sum(n * (n - 1) // 2 for n in sizes)
    best = greedy(sizes, 1000, 6)
    assert best == 0 and ours <= 0.01 * total < hashed
