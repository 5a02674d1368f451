"""Queries of the training-data operators and, where SQL can express them, their SQL."""

from __future__ import annotations

from pressmill.llm import (
    chat,
    decontaminate,
    langid,
    packing,
    quality,
    sharding,
    simhash,
    tokens,
    topk,
    wavelet,
)

QUERIES = {
    "op1_token_counts": tokens.op1_token_counts,
    "op2_simhash": simhash.op2_simhash,
    "op3_sharding": sharding.op3_sharding,
    "op4_topk": topk.op4_topk,
    "op5_quality": quality.op5_quality,
    "op6_wavelet": wavelet.op6_wavelet,
    "op7_language_id": langid.op7_language_id,
    "op8_packing": packing.op8_packing,
    "op9_decontaminate": decontaminate.op9_decontaminate,
    "op10_chat": chat.op10_chat,
}

#: The others rest on tokenizers, trained models, 64-bit hashes or searches that SQL has no words for.
ORACLE_SQL: dict[str, str] = {
    "op4_topk": topk.ORACLE_SQL,
    "op9_decontaminate": decontaminate.ORACLE_SQL,
    "op10_chat": chat.ORACLE_SQL,
}
