"""Operator 6 against all pairs."""

from __future__ import annotations

import random
import re

import numpy as np

from tillscan.llm.components import components
from tillscan.llm.near_dedup import dart_signatures, keep_one_of_each, near_classes, op6_near_dedup, similar_pairs
from tillscan.llm.text_arrays import shingles, word_hashes

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingle_set(text):
    w = WORD.findall(text)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())


def brute_classes(rows):
    """Class of each (id, text): the least id of all texts tied at 0.8 or more."""
    texts = sorted({t or "" for _, t in rows})
    sets = [shingle_set(t) for t in texts]
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and len(a & b) >= 0.8 * len(a | b):
                root[find(i)] = find(j)
    least = {}
    for i, t in rows:
        r = find(texts.index(t or ""))
        least[r] = min(least.get(r, i), i)
    return {(i, least[find(texts.index(t or ""))]) for i, t in rows}


def corpus(n=120, seed=3):
    draw = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(4000)]
    rows, at = [], 0
    for _ in range(n // 6):
        base = [draw.choice(vocabulary) for _ in range(draw.choice([3, 4, 5, 12, 60, 200]))]
        for _ in range(6):
            w = list(base)
            for _ in range(draw.choice([0, 0, 1, 2, 4, 9])):
                w[draw.randrange(len(w))] = draw.choice(vocabulary)
            rows.append((at, draw.choice([" ", "\n"]).join(w)))
            at += 1
    draw.shuffle(rows)
    return rows


def classes(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return {(r.doc, r["class"]) for r in near_classes(df).collect()}


def test_equals_brute_force(spark):
    rows = corpus()
    assert classes(spark, rows) == brute_classes(rows)


def test_blocks_give_the_same(spark, monkeypatch):
    from tillscan.llm import near_dedup

    rows = corpus(seed=4)
    monkeypatch.setattr(near_dedup, "BLOCK_TEXTS", 2)
    assert classes(spark, rows) == brute_classes(rows)


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, "a b"), (4, "a b"), (5, "a  b\n"), (6, "  "), (7, "b a"), (7, "b a"), (None, "a b")]
    got = dict(classes(spark, rows))
    low = -(2**63)
    assert got[1] == got[2] == 1 and got[3] == got[4] == got[5] == got[low] == low
    assert got[6] == 6 and got[7] == 7
    assert near_classes(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_texts_under_one_id_are_apart(spark, tmp_path):
    """Null and repeated ids tie nothing: unrelated texts stay, copies under the same id go."""
    draw = random.Random(6)

    def text(key):
        return [f"{key}{draw.randrange(10**6)}" for _ in range(60)]

    a, b, c, d, e = (" ".join(text(k)) for k in "abcde")
    near_c, near_e = c + " x", e + " y"
    rows = [(None, a), (None, b), (1, a), (2, b), (5, c), (5, near_c), (5, d), (6, near_c), (7, e), (7, near_e), (8, near_e)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    kept = [(r.doc_id, r.text) for r in keep_one_of_each(df).collect()]
    assert len(kept) == 5 and {t[0] for _, t in kept} == set("abcde")
    assert {i for i, t in kept if t[0] in "ab"} == {None} and sorted(i for i, t in kept if t[0] in "cde") == [5, 5, 7]
    groups = {}
    for r in near_classes(df).collect():
        groups.setdefault((r["class"], r.class_h1, r.class_h2), set()).add(r.doc)
    low = -(2**63)
    assert sorted(map(sorted, groups.values())) == sorted([[low, 1], [low, 2], [5, 6], [5], [7, 8]])
    df.write.parquet(f"{tmp_path}/documents.parquet")
    out = op6_near_dedup(spark, str(tmp_path)).collect()
    assert sorted((str(r.doc_id) for r in out if r.is_kept)) == ["5", "5", "7", "None", "None"]


def test_large_clusters_lose_no_link(spark, monkeypatch):
    """A base, noisy copies of it, and copies of the noisiest ones that only tie to those."""
    from tillscan.llm import near_dedup

    draw = random.Random(8)
    base = [f"b{i}" for i in range(150)]
    texts = [" ".join(base)]
    for k in range(60):
        w = list(base)
        for _ in range(k % 12):
            w[draw.randrange(150)] = f"n{draw.randrange(10**6)}"
        texts.append(" ".join(w))
        if k % 12 > 8:
            w[0] = f"m{k}"
            texts.append(" ".join(w))
    rows = list(enumerate(texts))
    draw.shuffle(rows)
    monkeypatch.setattr(near_dedup, "BLOCK_TEXTS", 7)
    assert classes(spark, rows) == brute_classes(rows)


def test_one_of_each_stays(spark):
    rows = [(1, "a b c d e f", "x"), (1, "a b c d e f", "x"), (2, "a b c d e f", "y"), (3, None, "z"), (4, "", "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, node string")
    out = keep_one_of_each(df)
    assert out.columns == df.columns
    assert sorted(r.doc_id for r in out.collect()) == [1, 3]


def weighted_jaccard(a, b):
    keys = set(a) | set(b)
    return sum(min(a.get(k, 0), b.get(k, 0)) for k in keys) / sum(max(a.get(k, 0), b.get(k, 0)) for k in keys)


def test_darts_estimate_weighted_similarity():
    draw = np.random.default_rng(2)
    k = 4096
    for scale in (0.3, 1.0, 7.5):
        keys = draw.integers(0, 2**46, 60, dtype=np.uint64)
        a = {int(x): float(w) * scale for x, w in zip(keys[:45], draw.integers(1, 9, 45), strict=True)}
        b = {int(x): float(w) * scale for x, w in zip(keys[15:], draw.integers(1, 9, 45), strict=True)}
        doc = np.r_[np.zeros(45, int), np.ones(45, int)]
        element = np.array([*a, *b], dtype=np.uint64)
        weight = np.array([*a.values(), *b.values()])
        sig = dart_signatures(doc, element, weight, 2, k)
        assert abs((sig[0] == sig[1]).mean() - weighted_jaccard(a, b)) < 0.035


def test_a_signature_depends_on_its_set_alone():
    texts = [f"t{i} u v w x y z {i}" for i in range(50)]
    d, e, _ = shingles(texts, 5)
    whole = dart_signatures(d, e, np.ones(len(d)), 50, 64)
    for i in (0, 7, 49):
        own_d, own_e, _ = shingles([texts[i]], 5)
        assert (dart_signatures(own_d, own_e, np.ones(len(own_d)), 1, 64)[0] == whole[i]).all()


def test_shingles_count_words_exactly():
    texts = ["", "a", "a b c d", "a b c d e", "x " * 50, "\x0b\x0c\r\t", "ä ö b c d e f"]
    d, _, times = shingles(texts, 5)
    for i, t in enumerate(texts):
        w = WORD.findall(t)
        assert (d == i).sum() == len(shingle_set(t))
        assert times[d == i].sum() == max(len(w) - 4, 1 if w else 0)
    assert word_hashes([])[0].size == 0


def test_similar_pairs_counts_exactly():
    texts = ["a b c d e f g h i j", "a b c d e f g h i k", "z y x w v u"]
    d, e, _ = shingles(texts, 5)
    assert [(i, h.tolist()) for i, h in similar_pairs((d, e, 3), (d, e, 3), 0.7, True)] == [(0, [1])]


def test_components_of_a_long_chain(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 101), (7, 7)]
    got = dict(components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert got == {**{i: 0 for i in range(61)}, 100: 100, 101: 100}
