"""Queries and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quire.plans import box_queries, line_queries, page_queries, record_queries, result_queries

MODULES = (page_queries, line_queries, box_queries, record_queries, result_queries)


def findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship query: all detectors over all pages."""
    return page_queries.QUERIES["findings"](spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for m in MODULES for k, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for m in MODULES for k, s in m.SQL.items()}
