"""Queries and SQL of the subpackage."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quire.llm import bpe, chat, exact_dedup, hard_negatives, html_extract, language_id, mixing, near_dedup, neighbours, resampling, sharding, toxicity, url_filter

MODULES = (toxicity, bpe, neighbours, mixing, language_id, url_filter, html_extract, exact_dedup, near_dedup, sharding, chat, hard_negatives, resampling)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for m in MODULES for k, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for m in MODULES for k, s in m.SQL.items()}
