"""The registered queries of this subpackage, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import exact_dedup, jaccard_join, language_id, line_quality, mixing, nearest, packing, pii, prefix_trie, suffix_dedup, token_rollup, va_clusters, window_dedup


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_packing": packing.op1_packing,
        "op2_language_id": language_id.op2_language_id,
        "op3_source_mix": mixing.op3_source_mix,
        "op4_token_rollup": token_rollup.op4_token_rollup,
        "op5_exact_dedup": exact_dedup.op5_exact_dedup,
        "op6_suffix_dedup": suffix_dedup.op6_suffix_dedup,
        "op7_personal_data": pii.op7_personal_data,
        "op8_nearest": nearest.op8_nearest,
        "op9_jaccard_join": jaccard_join.op9_jaccard_join,
        "op10_window_dedup": window_dedup.op10_window_dedup,
        "op11_conversation_trie": prefix_trie.op11_conversation_trie,
        "op12_line_quality": line_quality.op12_line_quality,
        "op13_centroid_clusters": va_clusters.op13_centroid_clusters,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op3_source_mix": mixing.OP3_SQL,
        "op5_exact_dedup": exact_dedup.OP5_SQL,
        "op9_jaccard_join": jaccard_join.OP9_SQL,
        "op10_window_dedup": window_dedup.OP10_SQL,
        "op11_conversation_trie": prefix_trie.OP11_SQL,
        "op13_centroid_clusters": va_clusters.OP13_SQL,
    }
