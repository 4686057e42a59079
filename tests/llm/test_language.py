"""Operator 10: held-out accuracy and the cases without a language."""

from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import functions as F

from tillscan.llm import language_id
from tillscan.llm.common import table
from tillscan.llm.language_id import BINS, fit, op10_language_id, predict, train, trigram_counts

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    lang = {r.doc_id: r.lang for r in table(spark, SF, "documents").select("doc_id", "lang").collect()}
    rows = op10_language_id(spark, SF).collect()
    assert len(rows) == len(lang)
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
        assert r.lang_pred in set(lang.values()) and 0 <= r.score <= 1
    held = [r for r in rows if r.held_out]
    assert sum(r.lang_pred == lang[r.doc_id] for r in held) >= 0.98 * len(held)


def test_counts_against_plain_python():
    texts = ["Ab c", "", "12 34", "éÉ\nx", "a" * 10, "İx"]
    counts = trigram_counts(texts)
    for t, c in zip(texts, counts, strict=True):
        assert c.sum() == sum(ch.isalpha() for ch in t.lower())
    joined = trigram_counts(["Ab c"])[0]
    assert (joined == counts[0]).all() and (trigram_counts(["ab  C!"])[0] == joined).all()
    assert counts.shape == (6, BINS)


def test_no_letters_no_language(spark):
    model = train(["hello there friend"] * 3 + ["guten tag freund"] * 3, ["en"] * 3 + ["de"] * 3)
    df = spark.createDataFrame([(1, None), (2, ""), (3, "12 !?"), (4, "hello friend"), (5, "guten freund")], "doc_id long, text string")
    got = {r.doc_id: r for r in predict(df.selectExpr("*", "'x' as score"), model, reject=False).collect()}
    assert [got[i].lang_pred for i in (1, 2, 3, 4, 5)] == ["und", "und", "und", "en", "de"]
    assert got[1].score == 0.0 and got[1].rejected
    assert predict(df.limit(0), model).count() == 0


def test_far_texts_are_rejected(spark):
    model = train(["the cat and the hat and the bat"] * 5, ["en"] * 5)
    df = spark.createDataFrame([(1, "the hat and the cat and the bat"), (2, "zyx qwv uj kkk")], "doc_id long, text string")
    assert [r.lang_pred for r in predict(df, model).orderBy("doc_id").collect()] == ["en", "und"]


def test_nothing_to_learn(spark):
    import pyspark.sql.functions as F

    df = spark.createDataFrame([(1, "abc", None)], "doc_id long, text string, lang string")
    model = fit(df, F.lit(True))
    assert predict(df, model).first().lang_pred == "und"


def test_order_does_not_matter():
    texts = [f"word{i} some thing {i}" for i in range(30)]
    langs = ["a" if i % 2 else "b" for i in range(30)]
    one, two = train(texts, langs), train(texts[::-1], langs[::-1])
    assert np.array_equal(one.centroids, two.centroids) and one.languages == two.languages


def test_long_texts_are_counted_by_piece(monkeypatch):
    text = "Über ΑΣ'Α straße, 12 x_y don't été\n" * 400 + "z" * 500
    wanted = language_id.trigram_counts([text, "kurz", ""])
    for size in (10, 333, 5000):
        monkeypatch.setattr(language_id, "PIECE", size)
        assert (language_id.trigram_counts([text, "kurz", ""]) == wanted).all()


def test_hundreds_of_languages(spark):
    """Each label of 301 has its own letters, and all are learned."""
    def text(k, i):
        return " ".join(f"{chr(0x4E00 + k)}{chr(0x4E00 + (k * 7 + j + i) % 5)}{chr(0x4E00 + k)}" for j in range(30))

    rows = [(i * 1000 + k, text(k, i), f"l{k:03d}") for k in range(301) for i in range(3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.fit(df, F.lit(True))
    assert len(set(model.languages)) == 301
    got = language_id.predict(df, model, reject=False).select("lang", "lang_pred").collect()
    assert sum(r.lang == r.lang_pred for r in got) > 0.95 * len(got)
