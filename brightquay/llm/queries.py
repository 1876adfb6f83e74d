"""Queries and SQL of the numbered operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from brightquay.llm import chat_format, exact_dedup, hard_negatives, katz, media, mixing, near_dup, packing, pii, quality, spelling, suffix_dedup, url_filter


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """One query per operator."""
    return {
        "op1_best_fit_packing": packing.op1_best_fit_packing,
        "op2_ngram_jaccard_join": near_dup.op2_ngram_jaccard_join,
        "op3_lm_scoring": katz.op3_lm_scoring,
        "op4_media_columns": media.op4_media_columns,
        "op5_suffix_dedup": suffix_dedup.op5_suffix_dedup,
        "op6_pii": pii.op6_pii,
        "op7_quality_classifier": quality.op7_quality_classifier,
        "op8_mixing": mixing.op8_mixing,
        "op9_exact_dedup": exact_dedup.op9_exact_dedup,
        "op10_chat_format": chat_format.op10_chat_format,
        "op11_hard_negatives": hard_negatives.op11_hard_negatives,
        "op12_spelling_variants": spelling.op12_spelling_variants,
        "op13_url_filter": url_filter.op13_url_filter,
    }


def oracle_sql() -> dict[str, str]:
    """DuckDB SQL of those that SQL expresses."""
    return {
        "op8_mixing": mixing.OP8_SQL,
        "op9_exact_dedup": exact_dedup.OP9_SQL,
        "op10_chat_format": chat_format.OP10_SQL,
        "op11_hard_negatives": hard_negatives.OP11_SQL,
        "op12_spelling_variants": spelling.OP12_SQL,
    }
