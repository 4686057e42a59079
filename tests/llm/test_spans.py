"""Operator 9 against plain Python."""

from __future__ import annotations

import random
import re

from tillscan.llm.span_dedup import cut_texts, dedup_spans, op9_span_dedup, sentences

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LEAST = -(2**63)


def runs(own, span, min_words):
    """(first, last, words) of the shortest run from every piece with a word."""
    words = [WORD.findall(p) for p in own]
    for i in range(len(own)):
        for j in range(i + span - 1, len(own)):
            run = tuple(w for p in words[i : j + 1] for w in p)
            if len(run) >= min_words:
                if words[i]:
                    yield i, j, run
                break


def brute(rows, span=2, min_words=20):
    first = {}
    pieces = [sentences(t or "") for _, t in rows]
    order = sorted(range(len(rows)), key=lambda i: LEAST if rows[i][0] is None else rows[i][0])
    for i in order:
        for p, _, run in runs(pieces[i], span, min_words):
            first.setdefault(run, (rows[i][0], p))
    out = []
    for (doc, _), own in zip(rows, pieces, strict=True):
        gone = set()
        for p, q, run in runs(own, span, min_words):
            if first[run] != (doc, p):
                gone |= set(range(p, q + 1))
        out.append((doc, len(own), len(gone), "".join(s for p, s in enumerate(own) if p not in gone)))
    return sorted(out, key=str)


def corpus():
    draw = random.Random(9)

    def sentence():
        return " ".join(f"w{draw.randrange(3000)}" for _ in range(draw.randint(1, 14))) + draw.choice([".", "!", "?", ".\n"])

    passages = [" ".join(sentence() for _ in range(7)) for _ in range(4)]
    rows = []
    for i in range(40):
        parts = [sentence() for _ in range(draw.randint(0, 9))]
        if i % 3 == 0:
            parts.insert(draw.randint(0, len(parts)), draw.choice(passages))
        rows.append((i, " ".join(parts)))
    return rows + [(40, None), (41, ""), (None, passages[0]), (42, "One. Two. Three. " * 9)]


def test_equals_brute_force(spark):
    rows = corpus()
    got = dedup_spans(spark.createDataFrame(rows, "doc_id long, text string"))
    got = got.select("doc_id", "n_sentences", "n_removed", "text").collect()
    assert sorted(map(tuple, got), key=str) == brute(rows)


def brute_all_runs(rows, span=2, min_words=20):
    """What stays if every run of enough sentences and words counts, not the shortest ones alone."""
    found, first = [], {}
    pieces = [sentences(t or "") for _, t in rows]
    for i in sorted(range(len(rows)), key=lambda i: LEAST if rows[i][0] is None else rows[i][0]):
        words = [WORD.findall(p) for p in pieces[i]]
        for p in range(len(words)):
            for q in range(p + span - 1, len(words)):
                run = tuple(w for own in words[p : q + 1] for w in own)
                if len(run) >= min_words:
                    found.append((i, p, q, run))
                    first.setdefault(run, (i, p))
    gone = [set() for _ in rows]
    for i, p, q, run in found:
        if first[run] != (i, p):
            gone[i] |= set(range(p, q + 1))
    kept = ["".join(s for k, s in enumerate(own) if k not in g) for own, g in zip(pieces, gone, strict=True)]
    return sorted(((d, t) for (d, _), t in zip(rows, kept, strict=True)), key=str)


def test_every_run_counts(spark, tmp_path):
    def sentence(key, n):
        return " ".join(f"{key}{i}" for i in range(n)) + ". "

    tail = sentence("a", 15) + sentence("b", 6) + sentence("c", 5)
    rows = [*corpus(), (50, tail), (51, tail), (52, sentence("d", 9) + tail + sentence("e", 8))]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r.text for r in op9_span_dedup(spark, str(tmp_path)).collect()}
    assert got[51] == "" and got[52] == sentence("d", 9) + sentence("e", 8)
    assert sorted(got.items(), key=str) == brute_all_runs(rows)


def test_a_passage_without_stops_is_found(spark):
    passage = " ".join(f"p{i}" for i in range(51))
    rows = [(1, f"Clean one here.\n{passage}\nAnother end."), (2, f"{passage}\nOther words, all new."), (3, "Nothing shared at all.")]
    got = {r.doc_id: r for r in dedup_spans(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1].n_removed == 0 and got[3].n_removed == 0
    assert got[2].text == "Other words, all new."


def test_passages_inside_sentences_are_found(spark):
    """Over 50 words put into the middle of other texts, at any word."""
    draw = random.Random(4)

    def words(n):
        return [f"v{draw.randrange(50000)}" + draw.choice(["", "", "", "", "", "", "", "."]) for _ in range(n)]

    rows, n = [], 60
    for i in range(n):
        passage = words(draw.randint(51, 60))
        for k in (0, 1):
            text = words(200)
            at = draw.randrange(200)
            rows.append((2 * i + k, " ".join(text[:at] + passage + text[at:])))
    got = {r.doc_id: r.n_removed_words for r in dedup_spans(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(got[2 * i] == 0 for i in range(n))
    assert sum(got[2 * i + 1] >= 20 for i in range(n)) >= 0.95 * n


def test_any_51_shared_words_share_a_run():
    """In sentences of any length, few or many words, with line feeds elsewhere: all of them."""
    draw = random.Random(5)
    for vocabulary, low, high in ((50000, 17, 24), (60, 17, 24), (50000, 20, 30), (3000, 1, 14), (60, 5, 60), (1, 9, 9)):

        def words(n, vocabulary=vocabulary, low=low, high=high):
            out, left = [], draw.randint(0, high)
            for _ in range(n):
                left -= 1
                out.append(f"v{draw.randrange(vocabulary)}" + ("." if left < 0 else ""))
                left = draw.randint(low, high) - 1 if left < 0 else left
            return out

        for white in (" ", " " * 11 + "\n"):
            texts, n = [], 300
            for _ in range(n):
                passage = words(51)
                for _ in (0, 1):
                    own = words(draw.randint(0, 80))
                    at = draw.randint(0, len(own))
                    texts.append("".join(w + draw.choice(white) for w in own[:at] + passage + own[at:]))
            cut = cut_texts(texts, every=True)
            runs = [set() for _ in texts]
            for number, key in zip(cut.text[cut.first].tolist(), zip(cut.h1.tolist(), cut.h2.tolist(), strict=True), strict=True):
                runs[number].add(key)
            assert all(runs[2 * i] & runs[2 * i + 1] for i in range(n))


def test_pieces_make_up_the_text():
    for _, text in corpus():
        assert "".join(sentences(text or "")) == (text or "")
    assert sentences("") == sentences(" \n") == [] and sentences(" a. b?)\n\nc") == [" a. ", "b?)\n\n", "c"]
    assert "".join(sentences("x" * 100 + "!" * 5000 + "y" + " a" * 99)) == "x" * 100 + "!" * 5000 + "y" + " a" * 99


def test_columns_and_nothing(spark):
    df = spark.createDataFrame([(1, "a b", 5, "k")], "doc_id long, text string, n_removed int, h1 string")
    (row,) = dedup_spans(df).collect()
    assert (row.n_removed, row.h1, row.text) == (0, "k", "a b")
    assert dedup_spans(df.limit(0)).count() == 0
