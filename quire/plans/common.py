"""What the queries share: tables, the mapping of documents to books, and pieces of SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession

from quire.functions.text import TAG, TRIM, WS
from quire.operators import pages as P
from quire.storage import spread


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "text")


def spread_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """docs for queries that work long on each text, over all cores."""
    return spread(docs(spark, sf_dir))


def pages(spark: SparkSession, sf_dir: str, *columns: Column) -> DataFrame:
    """A source's documents as the pages of a book, with their texts, or with columns made of these."""
    found = table(spark, sf_dir, "documents").select("source", "doc_id", "text")
    return P.book_pages(spread(found) if columns else found, *columns)


#: The same relations in SQL.
BP = "bp AS (SELECT source AS book_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS page_no, doc_id, text FROM documents)"
BK = BP + ", bk AS (SELECT book_id, count(*) AS page_count, sum(strlen(text)) AS byte_size FROM bp GROUP BY 1)"
CP = BK + ", per AS (SELECT book_id, page_count, ceil(page_count / least(50, greatest(1, ceil(page_count / 20), ceil(byte_size / 200000000))))::BIGINT AS per FROM bk), cp AS (SELECT book_id, format('c{:03d}', i + 1) AS chunk_id, i * per AS page_start, least(page_count - 1, (i + 1) * per - 1) AS page_end FROM (SELECT *, unnest(range(0, (page_count + per - 1) // per)) AS i FROM per))"


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def us(c: str) -> str:
    """ustrip in SQL."""
    return f"regexp_replace({c}, {quoted(TRIM)}, '', 'g')"


def plain_sql(c: str) -> str:
    return f"trim(regexp_replace(regexp_replace({c}, {quoted(TAG)}, '', 'g'), {quoted(f'[{WS}]+')}, ' ', 'g'))"


def squashed_sql(c: str) -> str:
    return f"lower(regexp_replace(regexp_replace({c}, {quoted(TAG)}, ' ', 'g'), {quoted(f'[{WS}]+')}, '', 'g'))"


def strip_math_sql(c: str) -> str:
    return f"regexp_replace(regexp_replace({c}, '(?s)\\$\\$.*?\\$\\$', '', 'g'), '\\$[^$\\n]*\\$', '', 'g')"


def any_sql(c: str, patterns) -> str:
    return "(" + " OR ".join(f"regexp_matches({c}, {quoted(p)})" for p in patterns) + ")"
