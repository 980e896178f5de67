"""Queries of the training-data operators, with their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lexiloom.llm import bpe, codes, language, lm, packing, periodic, quality, sharding, simhash, substring, tokencount, topk, urls


def _pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_quality_rules": quality.op1_quality_rules,
        "op2_substring_dedup": substring.op2_substring_dedup,
        "op3_token_counts": tokencount.op3_token_counts,
        "op4_lm_scoring": lm.op4_lm_scoring,
        "op5_exact_top_k": topk.op5_exact_top_k,
        "op6_jump_sharding": sharding.op6_jump_sharding,
        "op7_bpe_round_trip": bpe.op7_bpe_round_trip,
        "op8_url_filters": urls.op8_url_filters,
        "op9_best_fit_packing": packing.op9_best_fit_packing,
        "op10_simhash_near_dedup": simhash.op10_simhash_near_dedup,
        "op11_periodic_runs": periodic.op11_periodic_runs,
        "op12_language_id": language.op12_language_id,
        "op13_vector_codes": codes.op13_vector_codes,
        "pipeline": _pipeline,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_quality_rules": quality.oracle(),
        "op5_exact_top_k": topk.oracle(),
        "op8_url_filters": urls.oracle(),
        "op11_periodic_runs": periodic.oracle(),
        "op13_vector_codes": codes.oracle(),
    }
