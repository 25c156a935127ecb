"""Registered queries of this package and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidewatt.llm import decontaminate, extract, importance, language, mixing, neardup, quality, sharding, substrings, suffixes, tokens, topk, whitening

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_token_files": tokens.op1_token_files,
    "op2_quality": quality.op2_quality,
    "op3_top_k": topk.op3_top_k,
    "op4_near_duplicates": neardup.op4_near_duplicates,
    "op5_substrings": substrings.op5_substrings,
    "op6_hilbert_shards": sharding.op6_hilbert_shards,
    "op7_mix_sources": mixing.op7_mix_sources,
    "op8_extract": extract.op8_extract,
    "op9_language_id": language.op9_language_id,
    "op10_decontaminate": decontaminate.op10_decontaminate,
    "op11_importance": importance.op11_importance,
    "op12_whitening": whitening.op12_whitening,
    "op13_suffixes": suffixes.op13_suffixes,
}

ORACLE_SQL: dict[str, str] = {
    "op3_top_k": topk.OP3_SQL,
    "op7_mix_sources": mixing.OP7_SQL,
}
