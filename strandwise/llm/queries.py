"""Queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from strandwise.llm import chat_format, exact_dedup, language_id, line_dedup, lm_scoring, media, minhash_dedup, packing, sentencepiece_sampling, suffix_dedup

QUERIES = {
    "op1_media_columns": media.op1_media_columns,
    "op2_exact_dedup": exact_dedup.op2_exact_dedup,
    "op3_sentencepiece_sampling": sentencepiece_sampling.op3_sentencepiece_sampling,
    "op4_minhash_near_dedup": minhash_dedup.op4_minhash_near_dedup,
    "op5_best_fit_packing": packing.op5_best_fit_packing,
    "op6_suffix_dedup": suffix_dedup.op6_suffix_dedup,
    "op7_line_dedup": line_dedup.op7_line_dedup,
    "op8_lm_scoring": lm_scoring.op8_lm_scoring,
    "op9_language_id": language_id.op9_language_id,
    "op10_chat_formatting": chat_format.op10_chat_formatting,
}

ORACLE_SQL = {
    "op2_exact_dedup": exact_dedup.SQL,
    "op4_minhash_near_dedup": minhash_dedup.SQL,
    "op6_suffix_dedup": suffix_dedup.SQL,
    "op7_line_dedup": line_dedup.SQL,
    "op8_lm_scoring": lm_scoring.SQL,
    "op9_language_id": language_id.SQL,
    "op10_chat_formatting": chat_format.SQL,
}
