"""Registered queries of this subpackage and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from sitelens.llm import bpe, html_main, mixing, near_dedup, nearest, passages, periodic_runs, pii, quality_rules, sharding, stratified_index, token_counts, warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality_rules": quality_rules.quality_query,
    "op2_nearest": nearest.nearest_query,
    "op3_pii": pii.pii_query,
    "op4_sharding": sharding.sharding_query,
    "op5_warc": warc.warc_query,
    "op6_passages": passages.passages_query,
    "op7_bpe": bpe.bpe_query,
    "op8_mixing": mixing.mixing_query,
    "op9_html_main": html_main.html_query,
    "op10_near_dedup": near_dedup.near_dedup_query,
    "op11_periodic_runs": periodic_runs.periodic_runs_query,
    "op12_lexical_search": stratified_index.search_query,
    "op13_token_counts": token_counts.token_counts_query,
}

#: Queries whose whole result SQL can express; the learned, iterative and random ones have none and are tested by brute force.
ORACLE_SQL: dict[str, str] = {"op12_lexical_search": stratified_index.SEARCH_SQL}
