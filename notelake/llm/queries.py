"""Queries and SQL of this package, as __spark_entry__.py adds them."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import cover_trees, fingerprints, lm_scoring, near_dup, packing, piece_encoding, quality, ranked_search, sharding, suffix_dedup, tool_calls, warc, whitening

Query = Callable[[SparkSession, str], DataFrame]


def queries() -> dict[str, Query]:
    return {
        "pipeline": lambda spark, sf_dir: importlib.import_module("corpus_pipeline").run(spark, sf_dir),
        "op1_weighted_sampling": fingerprints.op1_weighted_sampling,
        "op2_tool_call_linking": tool_calls.op2_tool_call_linking,
        "op3_probminhash": near_dup.op3_probminhash,
        "op4_suffix_groups": suffix_dedup.op4_suffix_groups,
        "op5_prefix_table_encoding": piece_encoding.op5_prefix_table_encoding,
        "op6_robust_outliers": quality.op6_robust_outliers,
        "op7_vector_best_fit": packing.op7_vector_best_fit,
        "op8_stratified_interleaving": sharding.op8_stratified_interleaving,
        "op9_cross_entropy_difference": lm_scoring.op9_cross_entropy_difference,
        "op10_legacy_archive_converter": warc.op10_legacy_archive_converter,
        "op11_ranked_lexical_search": ranked_search.op11_ranked_lexical_search,
        "op12_dual_cover_trees": cover_trees.op12_dual_cover_trees,
        "op13_lanczos_whitening": whitening.op13_lanczos_whitening,
    }


def oracle_sql() -> dict[str, str]:
    return {"op10_legacy_archive_converter": warc.ORACLE, "op11_ranked_lexical_search": ranked_search.ORACLE, "op12_dual_cover_trees": cover_trees.ORACLE}
