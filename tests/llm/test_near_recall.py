"""Operator 6 on planted copies: recall and precision by rate of change, weighted and not."""

from __future__ import annotations

import random
from collections import Counter

import numpy as np
import pytest

from tillscan.llm import near_dedup
from tillscan.llm.near_dedup import _sets, dart_signatures, keep_one_of_each, near_classes
from tillscan.llm.text_arrays import shingles


def similarity(a, b, weight):
    def bag(t):
        w = t.split()
        c = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4)) or Counter([tuple(w)])
        return c if weight == "count" else Counter(set(c))

    x, y = bag(a), bag(b)
    return sum((x & y).values()) / max(sum((x | y).values()), 1)


def planted(seed, n=150, words=300):
    """Pairs of a text and a copy with some words changed, with their similarity."""
    draw = random.Random(seed)
    rows, pairs = [], []
    for i in range(n):
        own = [f"w{draw.randrange(5000)}" for _ in range(draw.randint(words // 3, words))]
        if i % 3 == 0:  # a passage that the text says many times weighs more than once
            own = own[:30] * 6 + own
        copy = list(own)
        for _ in range(draw.randint(0, max(1, len(own) // 25))):
            copy[draw.randrange(len(copy))] = f"x{draw.randrange(5000)}"
        rows += [(2 * i, " ".join(own)), (2 * i + 1, " ".join(copy))]
        pairs.append((2 * i, 2 * i + 1))
    return rows, pairs


@pytest.mark.parametrize("weight", ["set", "count"])
def test_planted_copies(spark, weight):
    rows, pairs = planted(11)
    text = dict(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc: r["class"] for r in near_classes(df, weight=weight).collect()}
    near = [p for p in pairs if similarity(text[p[0]], text[p[1]], weight) >= 0.8]
    far = [p for p in pairs if similarity(text[p[0]], text[p[1]], weight) < 0.8]
    assert len(near) > 40 and len(far) > 20
    assert sum(got[a] == got[b] for a, b in near) == len(near)  # recall
    assert sum(got[a] == got[b] for a, b in far) == 0  # precision
    assert all(got[a] == a for a, _ in pairs)


def test_weights_decide():
    """Two texts alike as sets and unlike as bags."""
    a = "one two three four five six " * 30 + "seven eight nine ten eleven twelve"
    b = "one two three four five six " * 2 + "seven eight nine ten eleven twelve"
    assert similarity(a, b, "set") >= 0.8 > similarity(a, b, "count")
    for weight, alike in (("set", True), ("count", False)):
        own = _sets([a, b], 5, weight)
        assert bool(list(near_dedup.similar_pairs(own, own, 0.8, True))) is alike


def test_signatures_agree_as_often_as_weights_say():
    draw = random.Random(5)
    a = " ".join(f"w{draw.randrange(40)}" for _ in range(400))
    b = a[: len(a) // 2] + " " + " ".join(f"w{draw.randrange(40)}" for _ in range(200))
    doc, element, times = shingles([a, b], 1)
    sig = dart_signatures(doc, element, times.astype(float), 2, 4096)
    x, y = Counter(a.split()), Counter(b.split())
    want = sum((x & y).values()) / sum((x | y).values())
    assert float((sig[0] == sig[1]).mean()) == pytest.approx(want, abs=0.03)
    assert not np.isnan(want)


@pytest.mark.parametrize("block", [1500, 20])
def test_unrelated_texts_under_one_id_stay(spark, monkeypatch, block):
    """Null and repeated ids: only true copies go, also where clusters exceed a block."""
    monkeypatch.setattr(near_dedup, "BLOCK_TEXTS", block)
    draw = random.Random(3)

    def text():
        return " ".join(f"w{draw.randrange(3000)}" for _ in range(120))

    base = text()
    noisy = [" ".join(f"n{draw.randrange(99)}" if draw.random() < 0.01 else w for w in base.split()) for _ in range(50)]
    unrelated = [(None, text()), (None, text()), (None, text()), (7, text()), (7, text()), (8, "short one")]
    rows = unrelated + [(None, unrelated[0][1])] + [(7 if i % 2 else 100 + i, t) for i, t in enumerate(noisy)]
    for weight in ("set", "count"):
        kept = keep_one_of_each(spark.createDataFrame(rows, "doc_id long, text string"), weight=weight).collect()
        left = Counter((r.doc_id, r.text) for r in kept)
        assert all(left[x] == 1 for x in unrelated)
        alike = {(i, j) for i in range(50) for j in range(50) if similarity(noisy[i], noisy[j], weight) >= 0.8}
        root = list(range(50))
        for _ in range(50):
            for i, j in alike:
                root[i] = root[j] = min(root[i], root[j])
        assert sum(t in set(noisy) for (_, t) in left) == len(set(root))


def test_a_very_long_text_has_its_copy(spark):
    draw = random.Random(2)
    words = [f"w{draw.randrange(4000)}" for _ in range(60_000)]
    copy = list(words)
    for i in range(0, 60_000, 500):
        copy[i] = "changed"
    rows = [(1, " ".join(words)), (2, " ".join(copy)), (3, " ".join(words[::-1])), (4, None), (5, "")]
    got = {r.doc: r["class"] for r in near_classes(spark.createDataFrame(rows, "doc_id long, text string"), weight="count").collect()}
    assert got == {1: 1, 2: 1, 3: 3, 4: 4, 5: 4}
