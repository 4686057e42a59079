"""Operator 7: targets by the stated procedure, the cube's invariants, reruns."""

from __future__ import annotations

import random
from collections import Counter, defaultdict

import pytest

from tillscan.llm import mixing
from tillscan.llm.mixing import _rows, flight, land, mix_documents, mix_sizes


def brute_targets(sizes):
    names = sorted((s for s in sizes if s is not None)) + [s for s in sizes if s is None]
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    total, full = sum(sizes.values()), {}
    while True:
        free = [s for s in names if s not in full]
        level = (total - sum(full.values())) / sum(weight[s] for s in free) if free else 0
        over = [s for s in free if weight[s] * level > 3 * sizes[s]]
        if not over:
            return {s: full.get(s, weight[s] * level) for s in names}
        full |= {s: 3.0 * sizes[s] for s in over}


def corpus(n=600, seed=1):
    draw = random.Random(seed)
    rows = []
    for i in range(n):
        source = draw.choice(["a"] * 30 + ["b", "c", "d", "é", "Z", None])
        rows.append((i, "w " * draw.randint(0, 60), source))
    return rows + [(9000, None, "empty"), (9001, "", "empty"), (None, "x y", "b"), (3, "same row", "c"), (3, "same row", "c")]


def mixed(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    return mix_sizes(_rows(df, "doc_id", "text", "source"))


@pytest.mark.parametrize("bucket", [4000, 8])
def test_targets_and_taken(spark, monkeypatch, bucket):
    monkeypatch.setattr(mixing, "BUCKET_ROWS", bucket)
    rows = corpus()
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += len((t or "").split())
    want = brute_targets(sizes)
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    plain = _rows(df, "doc_id", "text", "source")
    got = mix_sizes(plain)
    back = got.join(plain.select("doc", "row", "source").distinct(), (got.doc.eqNullSafe(plain.doc)) & (got.row == plain.row))
    back = back.select("source", "size", "source_size", "target", "copies").collect()
    assert len(back) == len(rows)
    taken = defaultdict(int)
    for r in back:
        assert r.source_size == sizes[r.source] and 0 <= r.copies <= 3
        assert r.target == pytest.approx(want[r.source])
        taken[r.source] += r.size * r.copies
    for s, t in want.items():
        assert abs(taken[s] - t) <= max(0.03 * t, 5), s


def test_reruns_and_partitions_agree(spark):
    rows = corpus(200)
    one = sorted(map(tuple, mixed(spark, rows).collect()), key=str)
    random.Random(5).shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(7)
    two = sorted(map(tuple, mix_sizes(_rows(df, "doc_id", "text", "source")).collect()), key=str)
    assert one == two


def test_the_mix_repeats_rows(spark):
    rows = corpus(200)
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").selectExpr("*", "1 as n", "2 as row", "3 as doc", "4 as copies")
    taken = sum(r.copies for r in mix_sizes(_rows(df, "doc_id", "text", "source")).collect())
    out = mix_documents(df)
    assert out.columns == df.columns and out.count() == taken
    assert max(Counter(r.doc_id for r in out.collect()).values()) <= 9  # doc 3 stands three times
    assert mix_documents(df.limit(0)).count() == 0


def test_flight_keeps_both_sums():
    draw = random.Random(2)
    for n in (1, 2, 3, 10, 500):
        size = [draw.randint(0, 90) for _ in range(n)]
        p = [draw.random() for _ in range(n)]
        before = sum(p), sum(x * s for x, s in zip(p, size, strict=True))
        left = flight(p, size, draw)
        after = sum(p), sum(x * s for x, s in zip(p, size, strict=True))
        assert len(left) <= 2 and all(x in (0.0, 1.0) for i, x in enumerate(p) if i not in left)
        assert after == pytest.approx(before)
        land(p, size, left, before[1])
        assert set(p) <= {0.0, 1.0}
        assert abs(sum(x * s for x, s in zip(p, size, strict=True)) - before[1]) <= 90


def test_inclusion_follows_the_probabilities():
    hits = Counter()
    size = [3, 50, 7, 7, 20, 1, 9, 30]
    for seed in range(4000):
        p = [0.3] * 8
        left = flight(p, size, random.Random(seed))
        hits.update({i: p[i] for i in range(8)})
        assert len(left) <= 2
    assert all(abs(hits[i] / 4000 - 0.3) < 0.04 for i in range(8))


def test_rows_alike_are_one_unit(spark, monkeypatch):
    """However often a row repeats, a bucket does not grow, and each is there once."""
    monkeypatch.setattr(mixing, "SPREAD", 700)
    seen = []
    frame = [(1, "four words stand here", "a")] * 20_000 + [(i, "w " * (i % 40), "b") for i in range(500)] + [(None, None, None)] * 30
    df = spark.createDataFrame(frame, "doc_id long, text string, source string").repartition(6)
    units = mixing.mix_units(_rows(df, "doc_id", "text", "source")).collect()
    assert len(units) == 502 and sum(u.m for u in units) == 20_530
    got = mix_sizes(_rows(df, "doc_id", "text", "source")).collect()
    assert len(got) == 20_530 and all(0 <= r.copies <= 3 for r in got)
    for size in {r.source_size for r in got if r.source_size}:
        own = [r for r in got if r.source_size == size]
        seen.append(abs(sum(r.size * r.copies for r in own) - own[0].target))
    assert max(seen) <= 4
    assert mix_documents(df).count() == sum(r.copies for r in got)


def test_landing_keeps_the_number_of_documents():
    draw = random.Random(7)
    for n in (1, 2, 3, 30, 2000):
        size = [draw.randint(0, 900) for _ in range(n)]
        p = [draw.random() for _ in range(n)]
        expected, words = sum(p), sum(x * s for x, s in zip(p, size, strict=True))
        left = flight(p, size, draw)
        land(p, size, left, words)
        assert abs(sum(p) - expected) < 1 + 1e-6
        if n >= 2000:
            assert abs(sum(x * s for x, s in zip(p, size, strict=True)) - words) <= 2
