"""Operator 2: exact counts, Viterbi against all labelings, held-out accuracy."""

from __future__ import annotations

import itertools
import re
from collections import Counter

import numpy as np
import pytest

from tillscan.llm.common import table
from tillscan.llm.quality import FEATURES, Crf, fit, judge, label_documents, measure, train

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SF = "/root/testdata/sf0.01"


def brute(text):
    w = WORD.findall(text)
    runs = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    covered = {j for i in range(len(w) - 4) if runs[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
    seen, dups = set(), 0
    for line in text.split("\n"):
        dups += bool(WORD.search(line)) and line in seen
        seen.add(line)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), dups, len(covered)


TEXTS = [
    "", "\n\n", "a", " a b\n a b\nx", "one two three four five one two three four five six",
    "a a a a a a a", "ä#ö |\x0b<b>\x1c x\n\n \nä#ö |", "x y z " * 400, "A&B **!! " * 7 + "\r\n", "　 wide words",
]


def test_base_counts_are_exact():
    got = measure(TEXTS).base
    rows = zip(*(got[c].tolist() for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")), strict=True)
    assert list(rows) == [brute(t) for t in TEXTS]


def test_viterbi_finds_the_best_labels():
    draw = np.random.default_rng(1)
    for n in (1, 2, 5, 8):
        model = Crf(np.zeros(len(FEATURES)), draw.normal(size=(2, 2)))
        scores = draw.normal(size=n)

        def value(y, model=model, scores=scores):
            return sum(s * v for s, v in zip(scores, y, strict=True)) + sum(model.moves[a, b] for a, b in itertools.pairwise(y))

        best = max(itertools.product((0, 1), repeat=n), key=value)
        assert tuple(model.viterbi(scores)) == best


def test_without_labels_the_base_decides():
    out = judge(["word " * 3, "some words that are all different and number more than ten in here"], train([], []))
    assert out["kept"] == [False, True] and out["boilerplate_lines"] == [[], []]


def test_held_out_accuracy(spark):
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels").toPandas()
    model = fit(docs.filter("doc_id % 2 = 0"), table(spark, SF, "labels"))
    held = docs.filter("doc_id % 2 = 1").join(table(spark, SF, "labels"), "doc_id").select("doc_id", "text", "quality")
    rows = label_documents(held, model).select("quality", "kept", "base_failed").collect()
    clean = [r for r in rows if r.quality == 1 and not r.base_failed]
    poor = [r for r in rows if r.quality == 0]
    assert sum(r.kept for r in clean) >= 0.98 * len(clean)
    assert sum(not r.kept for r in poor) >= 0.85 * len(poor)
    assert len(labels) and len(clean) > 50


def test_columns_and_odd_rows(spark):
    df = spark.createDataFrame([(1, None, 3, "z"), (None, "a\nb", 4, None), (1, None, 3, "z")], "doc_id long, text string, kept int, base string")
    out = label_documents(df, Crf.silent())
    assert [f for f in out.columns if f in df.columns] == ["doc_id", "text", "base", "kept"]
    assert [r.kept for r in out.collect()] == [False] * 3
    assert label_documents(df.limit(0), Crf.silent()).count() == 0


@pytest.mark.parametrize("quality", [[], [1, 1], [None, None]])
def test_fit_needs_both_kinds(spark, quality):
    docs = spark.createDataFrame([(1, "a b"), (2, "c d")], "doc_id long, text string")
    labels = spark.createDataFrame([(i + 1, q) for i, q in enumerate(quality)], "doc_id long, quality int")
    assert (fit(docs, labels).weights == Crf.silent().weights).all()
