from __future__ import annotations

import hashlib
import math
import random
import re
from collections import Counter
from zlib import crc32

import numpy as np
import pytest

from tillscan.llm import importance

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def features(text, n=2):
    words = WORD.findall((text or "").translate(UPPER))
    return words, [" ".join(words[i : i + k]) for k in range(1, n + 1) for i in range(len(words) - k + 1)]


def brute(docs, target, buckets=10_000, share=25):
    def count(texts):
        return Counter(crc32(f.encode()) % buckets for t in texts for f in features(t)[1])

    s, t = count(x for _, x in docs), count(target)
    S, T = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1.0) * (S + buckets) / ((s[b] + 1.0) * (T + buckets)))) for b in range(buckets)]
    rows = []
    for i, text in docs:
        words, fs = features(text)
        weight = sum(gain[crc32(f.encode()) % buckets] for f in fs) // len(fs) if fs else 0
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        rows.append((i, len(fs), weight, score, len(words)))
    able = sorted((r for r in rows if r[4] >= 20), key=lambda r: (-r[3], r[0] is not None, r[0] or 0, r[2], r[1], r[4]))
    drawn = able[: share * len(able) // 100]
    left = Counter(rows) - Counter(drawn)
    return sorted([(*r[:4], k) for k, r in enumerate(drawn, 1)] + [(*r[:4], None) for r in left.elements()], key=str)


def texts(seed, n):
    r = random.Random(seed)
    words = [f"W{r.randrange(60)}" if r.random() < 0.9 else r.choice(["É", "don't", "naïve", "日本", "x-y", "A1"]) for _ in range(n)]
    return "".join(w + r.choice([" ", " ", ", ", "\n", "\x00", " "]) for w in words)


DOCS = [(i, texts(i, i % 70)) for i in range(150)] + [
    (None, None), (None, texts(3, 40)), (None, texts(3, 40)), (7, texts(7, 50)), (7, texts(7, 50)), (7, texts(8, 50)),
    (900, ""), (901, "... \n "), (902, "word " * 3000), (903, "x" * 9000),
]


def got(spark, docs, target, **kw):
    d = spark.createDataFrame([(*x, "s", 5) for x in docs], "doc_id long, text string, score string, rank int").repartition(5)
    t = spark.createDataFrame([(x,) for x in target], "text string")
    rows = importance.resample(d, t, **kw).select("doc_id", "n_features", "weight", "score", "rank").collect()
    return sorted(map(tuple, rows), key=str)


@pytest.mark.parametrize("target", [[texts(1, 300), None, texts(2, 20)], []])
def test_equals_brute_force(spark, target):
    assert got(spark, DOCS, target) == brute(DOCS, target)


def test_ties_and_rows_alike(spark):
    docs = [(5, texts(1, 30))] * 40 + [(6, texts(2, 30))] * 3
    rows = got(spark, docs, [texts(1, 30)], share=50)
    assert rows == brute(docs, [texts(1, 30)], share=50)
    assert sorted(r[4] for r in rows if r[4]) == list(range(1, 22))


def test_empty_table(spark):
    assert got(spark, [], ["a b"]) == []


def test_longer_runs_and_blocks(monkeypatch):
    """The ring carries over blocks of any size, for any length of runs."""
    text = texts(4, 400).encode()
    for n in (1, 2, 3, 5):
        wanted = sorted(crc32(f.encode()) for f in features(text.decode(), n)[1])
        for size in (1, 7, 50, 10**6):
            monkeypatch.setattr(importance, "BLOCK_BYTES", size)
            found = [c for block in importance.crc_ring(text, n) for level in block for c in level]
            assert sorted(found) == wanted


def test_gains_are_floored():
    s, t = np.array([0, 5, 100]), np.array([3, 0, 100])
    k, S, T = 3, 105, 103
    assert importance.gains(s, t).tolist() == [
        math.floor(1000 * math.log((b + 1) * (S + k) / ((a + 1) * (T + k)))) for a, b in zip(s, t, strict=True)
    ]
