"""What reaches the driver is bounded, whatever repeats; models against plain versions."""

from __future__ import annotations

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tillscan.llm import common, language_id, quality


def seen_by(monkeypatch, module):
    """The texts that reach training."""
    got: list[list[str]] = []

    def record(texts, *others):
        got.append(list(texts))
        return None

    monkeypatch.setattr(module, "train", record)
    return got


def test_quality_sample_is_bounded_by_rows(spark, monkeypatch):
    got = seen_by(monkeypatch, quality)
    docs = spark.range(20_000).select(F.lit(7).alias("doc_id"), F.concat(F.lit("a text of ten words that pass the rules number "), "id").alias("text"))
    labels = spark.createDataFrame([(7, 1), (7, 1), (8, 0), (None, 1), (9, None)], "doc_id long, quality int")
    quality.fit(docs, labels, sample=50)
    assert len(got[0]) == 50


def test_quality_sample_is_of_texts_that_fit(spark, monkeypatch):
    got = seen_by(monkeypatch, quality)
    rows = [(i, None if i % 3 == 0 else "x\n" * 5000 if i % 3 == 1 else f"text of ten words that all pass the rules number {i}") for i in range(300)]
    labels = [(i, i % 2) for i in range(600)]
    quality.fit(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int"), sample=30)
    assert len(got[0]) == 60 and all(t.startswith("text ") for t in got[0])


def test_a_text_of_line_feeds_costs_its_lines_alone():
    """Ragged arrays: one long text among many short ones."""
    texts = ["\n" * 990] + [f"A short good line of words {i}.\nAnother one." for i in range(300)] + ["*** &&& $$$\n### ###"] * 300
    model = quality.train(texts, [True] * 301 + [False] * 300, rounds=1, steps=20)
    assert quality.judge(["A line of ten words that says what it is there for.", "*** ### $$$ &&& *** ### $$$ &&& *** ### $$$"], model)["kept"] == [True, False]


def test_expected_labels_equal_enumeration():
    draw = np.random.default_rng(3)
    model = quality.Crf(np.zeros(2), draw.normal(size=(2, 2)))
    counts = [4, 3, 1]
    scores, start = draw.normal(size=8), [0, 4, 7]
    at = [np.array([s + t for s, c in zip(start, counts, strict=True) if c > t]) for t in range(4)]
    label, moves = quality._expected(model, scores, at, np.ones(3))
    want, want_moves = np.zeros(8), np.zeros((2, 2))
    for s, c in zip(start, counts, strict=True):
        paths = [[k >> i & 1 for i in range(c)] for k in range(2**c)]
        weight = [
            math.exp(sum(scores[s + i] for i in range(c) if p[i]) + sum(model.moves[p[i], p[i + 1]] for i in range(c - 1))) for p in paths
        ]
        for p, w in zip(paths, weight, strict=True):
            for i in range(c):
                want[s + i] += p[i] * w / sum(weight)
                if i:
                    want_moves[p[i - 1], p[i]] += w / sum(weight)
    assert label == pytest.approx(want) and moves == pytest.approx(want_moves)


def test_language_sample_is_bounded_by_rows_and_labels(spark, monkeypatch):
    got = seen_by(monkeypatch, language_id)
    docs = spark.range(20_000).select(F.lit(7).alias("doc_id"), F.lit("en").alias("lang"), F.concat(F.lit("text "), "id").alias("text"))
    language_id.fit(docs, F.lit(True), sample=100)
    assert len(got[-1]) == 100
    alike = docs.withColumn("text", F.lit("all alike"))
    language_id.fit(alike, F.lit(True), sample=100)
    assert got[-1] == ["all alike"] * 100
    many = spark.range(5000).select(F.col("id").alias("doc_id"), F.concat(F.lit("l"), "id").alias("lang"), F.lit("some text").alias("text"))
    language_id.fit(many, F.lit(True), sample=100, languages=40)
    assert len(got[-1]) == 40  # one row each of forty languages


def plain_counts(text):
    """Letter trigrams with one break around words, by hash bin."""
    out, word = Counter(), "\n"
    for c in [*text.lower(), "\n"]:
        if c.isalpha():
            word += c
            continue
        if len(word) > 1:
            word += "\n"
            out.update(word[i - 1 : i + 2] for i in range(1, len(word) - 1))
        word = "\n"
    return out


def plain_bin(gram):
    mask = 2**64 - 1
    codes = [0 if c == "\n" else ord(c) for c in gram]
    odd = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)
    x = sum(c * o for c, o in zip(codes, odd, strict=True)) & mask
    x ^= x >> 30
    x = x * 0xBF58476D1CE4E5B9 & mask
    x ^= x >> 27
    x = x * 0x94D049BB133111EB & mask
    return (x ^ x >> 31) % language_id.BINS


def test_nearest_centroid_equals_brute_force():
    """Cosines of TF-IDF vectors with every centroid, one text and one centroid at a time."""
    draw = random.Random(8)
    words = {"aa": ["lorem", "ipsum", "dolor", "sit"], "bb": ["kalt", "über", "straße", "und"], "cc": ["çà", "où", "être", "l'eau"]}
    texts, names = [], []
    for name, own in words.items():
        for _ in range(40):
            texts.append(" ".join(draw.choice(own) for _ in range(draw.randint(1, 30))))
            names.append(name)
    model = language_id.train(texts, names)
    assert Counter(model.languages) == {"aa": 3, "bb": 3, "cc": 3}
    asked = [*texts[::7], "lorem und", "Lorem\nIPSUM 12", "", "123 !?", "x", "Straße " * 500]
    found = []
    for t in asked:
        vector = [0.0] * language_id.BINS
        for gram, n in plain_counts(t).items():
            vector[plain_bin(gram)] += n
        vector = [math.sqrt(v) * w for v, w in zip(vector, model.idf.tolist(), strict=True)]
        norm = math.sqrt(sum(v * v for v in vector))
        if not norm:
            found.append(("und", 0.0))
            continue
        like = [sum(a * b for a, b in zip(vector, c, strict=True)) / norm for c in model.centroids.tolist()]
        best = max(range(len(like)), key=lambda i: (like[i], -i))
        found.append((model.languages[best], like[best]))
    language, score, _ = model.predict(asked)
    assert language == [f[0] for f in found]
    assert score == pytest.approx([f[1] for f in found], abs=1e-4)


def test_no_local_folder_on_a_cluster(monkeypatch):
    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()

        class conf:
            @staticmethod
            def get(key, default):
                return default

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        common.ensure_checkpoint_dir(Session())
