"""Operator 9 with its texts dealt to many parts, against plain Python that splits by itself."""

from __future__ import annotations

import random
import re
import time

import pytest
from pyspark.sql import functions as F

from tillscan.llm.span_dedup import cut_texts, dedup_spans

WORD = re.compile(r"[^\x20\x09-\x0D]+")
STOP = re.compile(r"(?<=[.!?])[\x20\x09-\x0D]+|(?<=[.!?][\"')\]])[\x20\x09-\x0D]+|[\x20\x09-\x0D]*\n[\x20\x09-\x0D]*")


def split(text):
    """Sentences with the white space after them; no cut elsewhere."""
    out, at = [], 0
    for m in STOP.finditer(text):
        out.append(text[at : m.end()])
        at = m.end()
    return [s for s in [*out, text[at:]] if WORD.search(s)]


def brute(rows, min_words, span=2):
    """(doc, text) pairs: every run of whole sentences, first by (doc, position)."""
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    first, found = {}, []
    for doc, text in order:
        own = split(text or "")
        words = [WORD.findall(s) for s in own]
        for p in range(len(own)):
            for q in range(p + span - 1, len(own)):
                run = tuple(w for x in words[p : q + 1] for w in x)
                if len(run) >= min_words:
                    found.append(((doc, text), p, q, run))
                    first.setdefault(run, ((doc, text), p))
    gone = {}
    for doc, p, q, run in found:
        if first[run] != (doc, p):
            gone.setdefault(doc, set()).update(range(p, q + 1))
    return sorted(
        ((d, "".join(s for k, s in enumerate(split(t or "")) if k not in gone.get((d, t), ()))) for d, t in rows), key=str
    )


def corpus(draw):
    def sentence():
        return " ".join(f"w{draw.randrange(2000)}" for _ in range(draw.randint(2, 9))) + draw.choice([".", "!", "?"])

    passages = [" ".join(sentence() for _ in range(draw.randint(2, 6))) for _ in range(5)]
    rows = []
    for i in range(80):
        parts = [sentence() for _ in range(draw.randint(0, 8))]
        for _ in range(draw.randint(0, 2)):
            parts.insert(draw.randint(0, len(parts)), draw.choice(passages))
        rows.append((i, " ".join(parts)))
    return rows


@pytest.mark.parametrize("min_words", [1, 12])
@pytest.mark.parametrize("part_bytes", [700, 10**9])
def test_whole_sentences_equal_brute_force(spark, min_words, part_bytes):
    """Sentences under eleven words are never cut, so a splitter of its own finds the same."""
    rows = corpus(random.Random(min_words))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = dedup_spans(df, min_words=min_words, every=True, part_bytes=part_bytes).select("doc_id", "text").collect()
    assert sorted(map(tuple, got), key=str) == brute(rows, min_words)


def test_two_short_sentences_go_if_asked(spark):
    rows = [(1, "Four words are here. And five words are there. Own end."), (2, "Start. Four words are here. And five words are there.")]
    got = dict(dedup_spans(spark.createDataFrame(rows, "doc_id long, text string"), min_words=1).select("doc_id", "text").collect())
    assert got[1] == rows[0][1] and got[2] == "Start. "


def test_rows_that_share_an_id(spark):
    long = " ".join(f"a{i}" for i in range(30)) + ". " + " ".join(f"b{i}" for i in range(8)) + "."
    rows = [(None, "x " + long), (None, "y " + long), (None, "y " + long), (7, long), (7, "Other. " + long), (7, long), (8, None)]
    for part_bytes in (10, 10**9):
        got = dedup_spans(spark.createDataFrame(rows, "doc_id long, text string"), every=True, part_bytes=part_bytes).collect()
        assert len(got) == 7
        whole = [r for r in got if r.n_removed == 0 and r.text]
        assert len({(r.doc_id, r.text) for r in whole}) == 1 and whole[0].doc_id is None
        seven = sorted(r.text for r in got if r.doc_id == 7)
        # What stands before the first cut has another neighbour in the text that stays.
        assert seven.count(seven[1]) == 2 and all(len(t.split()) <= 12 for t in seven)


def test_work_grows_with_the_texts_alone(spark):
    """Many texts that all lose a passage take time in proportion."""
    passage = " ".join(f"p{i}" for i in range(60)) + "."
    took = []
    for n in (2000, 8000):
        df = spark.createDataFrame([(i, f"Own text number {i}. {passage} End {i}.") for i in range(n)], "doc_id long, text string")
        began = time.time()
        assert dedup_spans(df, every=True, part_bytes=10**9).filter("n_removed > 0").count() == n - 1
        took.append(time.time() - began)
    assert took[1] < 8 * took[0] + 5


def test_a_very_long_text():
    text = " ".join(f"w{i % 977}" for i in range(300_000))
    cut = cut_texts([text, "", "a"], every=True)
    assert cut.counts[1] == 0 and cut.counts[2] == 1 and "".join(cut.of(0)) == text


def test_copies_of_short_texts_go_as_a_whole(spark):
    short = "One sentence of eight words stands in here. Another sentence of eight words stands there too."
    rows = [(1, short), (2, short.replace(". ", ".\n")), (3, short + " And one more."), (4, "Other words."), (None, "a. b.")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.text for r in dedup_spans(df, every=True, whole=True).collect()}
    assert got == {1: short, 2: "", 3: short + " And one more.", 4: "Other words.", None: "a. b."}
    assert dedup_spans(df, every=True).filter("n_removed > 0").count() == 0


def test_rows_alike_lie_in_many_parts(spark):
    """Two thousand equal rows are no one group, and all get what one of them gets."""
    long = " ".join(f"w{i}" + (". " if i % 9 == 8 else "") for i in range(90))
    rows = [(5, long)] * 2000 + [(4, long)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    parts = F.lit(50)
    part = F.pmod(F.xxhash64(F.monotonically_increasing_id()), parts)
    assert df.groupBy(part).count().agg(F.max("count")).first()[0] < 100
    got = dedup_spans(df, every=True, whole=True, part_bytes=20_000).groupBy("doc_id", "text").count().collect()
    assert sorted(map(tuple, got)) == [(4, long, 1), (5, "", 2000)]
