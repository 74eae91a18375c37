"""Queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from rookery.llm import divergence, lm_scoring, media, merkle, mixing, near_dedup, neighbours, packing, quality, sharding, suffix_dedup, token_files, toxicity


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_suffix_dedup": suffix_dedup.query,
        "op2_minhash_near_dedup": near_dedup.query,
        "op3_best_fit_packing": packing.query,
        "op4_media_jpeg": media.query,
        "op5_token_files": token_files.query,
        "op6_source_mixing": mixing.query,
        "op7_toxicity": toxicity.query,
        "op8_sharding": sharding.query,
        "op9_nearest_neighbours": neighbours.query,
        "op10_lm_scoring": lm_scoring.query,
        "op11_merkle_manifest": merkle.query,
        "op12_quality_classifier": quality.query,
        "op13_source_divergence": divergence.query,
    }


def oracle_sql() -> dict[str, str]:
    return {"op6_source_mixing": mixing.ORACLE, "op11_merkle_manifest": merkle.ORACLE, "op13_source_divergence": divergence.ORACLE}
