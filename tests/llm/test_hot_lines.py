"""Operator 5 where few lines hold most of the rows."""

from __future__ import annotations

import pytest

from tillscan.llm import line_dedup
from tillscan.llm.line_dedup import dedup_lines


def brute(rows, min_docs):
    docs: dict[str, set[int]] = {}
    for doc, text in rows:
        for line in text.split("\n"):
            docs.setdefault(line, set()).add(doc)
    gone = {k: min(d) for k, d in docs.items() if len(k) >= 10 and len(d) >= min_docs}
    out = []
    for doc, text in rows:
        lines = text.split("\n")
        kept = [x for x in lines if gone.get(x, doc) == doc]
        out.append((doc, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out)


@pytest.mark.parametrize("min_docs", [2, 3])
def test_hot_lines_meet_no_task(spark, monkeypatch, min_docs):
    monkeypatch.setattr(line_dedup, "HOT_LINES", 20)
    rows = [
        (i, "\n".join(["a very common line", f"own line of document {i}", f"shared by few {i // 2}", "a very common line", "short", ""][: 2 + i % 5]))
        for i in range(200)
    ]
    rows += [(7, "another text of seven\na very common line"), (7, "another text of seven\na very common line")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = dedup_lines(df, min_docs=min_docs).select("doc_id", "n_lines", "n_dropped", "text").collect()
    assert sorted(map(tuple, got)) == brute(rows, min_docs)
    monkeypatch.setattr(line_dedup, "HOT_LINES", 10**6)
    again = dedup_lines(df, min_docs=min_docs).select("doc_id", "n_lines", "n_dropped", "text").collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, got))
