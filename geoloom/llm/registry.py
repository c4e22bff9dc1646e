"""Queries of this subpackage and their SQL, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import byte_bpe, filter_audit, flac, language_id, near_dedup, nearest, oracles, packing, quality, resampling, substring_dedup, token_files, toxicity, warc


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_warc": warc.query,
        "op2_toxicity": toxicity.query,
        "op3_token_files": token_files.query,
        "op4_nearest": nearest.query,
        "op5_language_id": language_id.query,
        "op6_byte_bpe": byte_bpe.query,
        "op7_near_dedup": near_dedup.query,
        "op8_quality": quality.query,
        "op9_flac": flac.query,
        "op10_best_fit": packing.query,
        "op11_substring_dedup": substring_dedup.query,
        "op12_filter_audit": filter_audit.query,
        "op13_resampling": resampling.query,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_warc": oracles.WARC, "op7_near_dedup": oracles.NEAR_DEDUP, "op11_substring_dedup": oracles.SUBSTRING_DEDUP, "op12_filter_audit": oracles.FILTER_AUDIT, "op13_resampling": oracles.RESAMPLING}
