"""The registered queries of this package and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import byte_bpe, graph_search, language_id, licenses, mtree, near_dedup, packing, sorted_table, suffix_dedup, toxicity


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_language_id": language_id.query,
        "op2_suffix_dedup": suffix_dedup.query,
        "op3_mtree_top_k": mtree.query,
        "op4_byte_bpe": byte_bpe.query,
        "op5_sorted_table": sorted_table.query,
        "op6_graph_search": graph_search.query,
        "op7_packing": packing.query,
        "op8_near_dedup": near_dedup.query,
        "op9_toxicity": toxicity.query,
        "op10_licenses": licenses.query,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op2_suffix_dedup": suffix_dedup.SQL,
        "op3_mtree_top_k": mtree.SQL,
        "op8_near_dedup": near_dedup.SQL,
        "op10_licenses": licenses.oracle(),
    }
