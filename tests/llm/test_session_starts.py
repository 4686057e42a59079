"""op13: what a start of the stream costs, whatever it holds."""

from __future__ import annotations

from pyspark.sql.streaming.query import StreamingQuery

from tillscan.llm import session_close as S

from .test_sessions import SCHEMA, oracle, rows_of


def test_a_start_is_one_micro_batch_with_one_exchange(spark, monkeypatch):
    """The last start had two micro-batches, and each of them two exchanges: tasks for each partition of the state."""
    seen = []
    wait = StreamingQuery.awaitTermination

    def waited(q, *a):
        wait(q, *a)
        seen.append((q.lastProgress["batchId"], q._jsq.explainInternal(False).count("Exchange ")))

    monkeypatch.setattr(StreamingQuery, "awaitTermination", waited)
    monkeypatch.setattr(S, "GROUP_CLIENTS", 4)
    rows = rows_of(7, 1500, 9)
    got = sorted(map(tuple, S.close_sessions(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()))
    assert got == oracle(rows)
    assert seen == [(b, 1) for b in range(13)]
