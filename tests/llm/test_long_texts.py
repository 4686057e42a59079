"""Very long texts and repeated rows in operators 2, 6 and 10."""

from __future__ import annotations

import random
import re
from collections import Counter

from tillscan.llm.language_id import predict, train
from tillscan.llm.near_dedup import near_classes
from tillscan.llm.quality import Crf, judge, label_documents, measure_all

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(n, seed, kinds=50_000):
    draw = random.Random(seed)
    return [f"w{draw.randrange(kinds)}" for _ in range(n)]


def repeated(w):
    runs = Counter(zip(w, w[1:], w[2:], w[3:], w[4:], strict=False))
    return len({j for i in range(len(w) - 4) if runs[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)})


def test_quality_counts_of_long_texts_are_exact():
    once = words(300_000, 1)
    twice = once[:40_000] + words(60_000, 2) + once[:40_000]
    texts = [" ".join(once), "short text", "\n".join(twice), "", "x" * 3_000_000]
    got = measure_all(texts).base
    want = [WORD.findall(t) for t in texts]
    assert got["n_words"].tolist() == [len(w) for w in want]
    assert got["word_chars"].tolist() == [sum(map(len, w)) for w in want]
    assert got["n_repeat_words"].tolist() == [repeated(w) for w in want]
    lines = twice
    assert got["n_dup_lines"].tolist()[2] == len(lines) - len(set(lines))


def test_the_end_of_a_long_text_counts(spark):
    text = " ".join(words(200_000, 3))
    rows = [(1, text), (1, text), (2, text + " " + " ".join(words(200, 4)) * 2)]
    out = label_documents(spark.createDataFrame(rows, "doc_id long, text string"), Crf.silent()).collect()
    want = judge([t for _, t in rows], Crf.silent())["kept"]
    assert sorted((r.doc_id, r.kept) for r in out) == sorted((i, k) for (i, _), k in zip(rows, want, strict=True))


def test_near_copies_of_long_texts(spark):
    base = words(100_000, 5)
    near, far, tail = list(base), list(base), words(100_000, 6)
    for i in range(0, 100_000, 100):  # about 5 % of the shingles, a similarity of 0.90
        near[i] = f"n{i}"
    for i in range(0, 100_000, 10):  # about half of the shingles, a similarity of 0.33
        far[i] = f"f{i}"
    rows = [(3, " ".join(base)), (5, " ".join(near)), (7, " ".join(far)), (9, " ".join(base[:1000] + tail)), (11, " ".join(base))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for weight in ("set", "count"):
        got = {(r.doc, r["class"]) for r in near_classes(df, weight=weight).collect()}
        assert got == {(3, 3), (5, 3), (7, 7), (9, 9), (11, 3)}


def test_languages_of_long_texts_and_repeated_rows(spark):
    model = train(["hello there friend"] * 3 + ["guten tag freund"] * 3, ["en"] * 3 + ["de"] * 3)
    # A prefix would give the other language.
    mixed = "hello there friend " * 1_000 + "guten tag freund " * 100_000
    rows = [(1, mixed), (1, mixed), (2, "hello there friend " * 100_000), (None, "1 " * 1_000_000), (None, "1 " * 1_000_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = sorted((r.doc_id or 0, r.lang_pred) for r in predict(df, model, reject=False).collect())
    assert out == [(0, "und"), (0, "und"), (1, "de"), (1, "de"), (2, "en")]
