"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from . import (
    bpe,
    chat_format,
    importance,
    language_id,
    line_dedup,
    mixing,
    mpeg_audio,
    near_dedup,
    packing,
    quality,
    session_close,
    sharding,
    span_dedup,
)

QUERIES = {
    "op1_sharding": sharding.op1_sharding,
    "op2_quality": quality.op2_quality,
    "op3_mpeg_audio": mpeg_audio.op3_mpeg_audio,
    "op4_bpe": bpe.op4_bpe,
    "op5_line_dedup": line_dedup.op5_line_dedup,
    "op6_near_dedup": near_dedup.op6_near_dedup,
    "op7_mixing": mixing.op7_mixing,
    "op8_chat_format": chat_format.op8_chat_format,
    "op9_span_dedup": span_dedup.op9_span_dedup,
    "op10_language_id": language_id.op10_language_id,
    "op11_packing": packing.op11_packing,
    "op12_importance": importance.op12_importance,
    "op13_session_close": session_close.op13_session_close,
}
SQL = {
    "op5_line_dedup": line_dedup.OP5_SQL,
    "op8_chat_format": chat_format.OP8_SQL,
    "op12_importance": importance.OP12_SQL,
    "op13_session_close": session_close.OP13_SQL,
}
