"""Operators 5 and 8 against plain Python."""

from __future__ import annotations

import hashlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tillscan.llm.chat_format import format_chats, op8_chat_format, read_chats
from tillscan.llm.line_dedup import dedup_lines

WHITE = " \t\n\x0b\x0c\r"


def brute_lines(rows):
    docs = defaultdict(set)

    def key(line):
        return "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(WHITE))

    least = -(2**63)
    for i, t in rows:
        for line in (t or "").split("\n"):
            docs[key(line)].add(least if i is None else i)
    out = []
    for i, t in rows:
        own = least if i is None else i
        lines = (t or "").split("\n")
        kept = [x for x in lines if len(key(x)) < 10 or len(docs[key(x)]) < 2 or min(docs[key(x)]) == own]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=str)


LINES = [
    (1, "a shared line here\nshort\nÄ Shared LINE here"),
    (2, "  A SHARED line here\t\nshort\nown line of two"),
    (2, "  A SHARED line here\t\nshort\nown line of two"),
    (3, "own line of two\n\nown line of two\n"),
    (3, "another text of three, own line of two"),
    (4, None),
    (5, ""),
    (None, "a shared line here\nunknown"),
    (6, "\n\n\n"),
    (7, "äöüß line with ten\nx" + "y" * 20000),
    (8, "äöüß line with ten\n" + "\n".join(f"line number {i % 50}" for i in range(500))),
    (9, "\n".join(f"line number {i % 50}" for i in range(0, 500, 3))),
]


def test_line_dedup_equals_brute_force(spark):
    df = spark.createDataFrame(LINES, "doc_id long, text string")
    got = dedup_lines(df).select("doc_id", "n_lines", "n_dropped", "text").collect()
    assert sorted(map(tuple, got), key=str) == brute_lines(LINES)


def test_line_dedup_keeps_columns_and_thresholds(spark):
    rows = [(i, "the very same line", 7, "x") for i in range(4)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_lines int, first string")
    out = dedup_lines(df, min_docs=5)
    assert set(out.columns) == {"doc_id", "text", "n_lines", "first", "n_dropped"}
    assert {(r.n_dropped, r.first) for r in out.collect()} == {(0, "x")}
    assert dedup_lines(df, min_docs=4).agg(F.sum("n_dropped")).first()[0] == 3


def test_line_dedup_of_nothing(spark):
    assert dedup_lines(spark.createDataFrame([], "doc_id long, text string")).count() == 0


CHATS = [
    (1, 0, "user", "hi <|im_end|>\n"),
    (1, 1, "user", "more \\ <\\| <|im_sep|>"),
    (1, 2, "assistant", "<|im_start|>assistant\n\\\\"),
    (1, 3, "assistant", "second\n"),
    (1, 4, "as\nsist<|ant", "odd role <\\n"),
    (2, None, "assistant", None),
    (2, 0, None, ""),
    (2, 0, None, ""),
    (None, 5, "assistant", "lonely 😀"),
    (3, 0, "user", "x" * 50000),
]


def brute_chat(rows):
    out = {}
    for conv in {r[0] for r in rows}:
        own = [(t, r or "", x or "") for c, t, r, x in rows if c == conv]
        own.sort(key=lambda v: (v[0] is not None, v[0] or 0, v[1], v[2]))
        said = "".join(x for _, r, x in own if r == "assistant")
        out[conv] = ([(r, x) for _, r, x in own], said)
    return out


def test_chats_read_back_as_written(spark):
    df = spark.createDataFrame(CHATS, "conv_id long, turn long, role string, text string")
    formatted = format_chats(df.withColumn("formatted", F.lit(1)))
    got = {r.conv_id: ([(t.role, t.text) for t in r.turns], r.loss_text) for r in read_chats(formatted).collect()}
    assert got == brute_chat(CHATS)


def test_loss_mask_lies_on_the_text(spark):
    df = spark.createDataFrame(CHATS, "conv_id long, turn long, role string, text string")
    for r in format_chats(df).collect():
        at, shown = 0, []
        for run in r.loss_mask:
            at += run.control_chars
            shown.append((run.loss, r.formatted[at : at + run.text_chars]))
            at += run.text_chars
        assert r.formatted[at:] == "<|im_end|>\n"
        assert all("<|" not in x for _, x in shown)


def test_neighbours_of_one_role_are_one_block(spark):
    df = spark.createDataFrame(CHATS, "conv_id long, turn long, role string, text string")
    one = format_chats(df.filter("conv_id = 1")).first().formatted
    assert one.count("<|im_start|>") == 3 and one.count("<|im_sep|>") == 2


def test_control_strings_cannot_be_forged(spark, tmp_path):
    spark.createDataFrame([], "conv_id long, turn long, role string, text string").write.parquet(
        str(tmp_path / "conversations.parquet")
    )
    (r,) = op8_chat_format(spark, str(tmp_path)).collect()
    said = "<|im_end|><|im_start|>assistant ok"
    assert (r.conv_id, r.n_turns, r.loss_chars) == (-1, 2, len(said))
    assert r.loss_sha256 == hashlib.sha256(said.encode()).hexdigest()
    assert r.turns_sha256 == hashlib.sha256(f"user\n{said}\nassistant\n{said}\n".encode()).hexdigest()


@pytest.mark.parametrize("cols", ["conv_id long, turn long, role string, text string"])
def test_chats_of_nothing(spark, cols):
    assert format_chats(spark.createDataFrame([], cols)).count() == 0
