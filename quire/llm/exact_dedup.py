"""Exact deduplication with a heavy-hitter split (DataFrame operations only).

A Misra-Gries summary finds the digests that may be frequent. Their groups are counted and their winners
chosen exactly; these at most ``1 / SUPPORT`` winners are broadcast, so the rows of hot groups are settled where
they are read and never meet in one task. All other digests are shuffled as usual: counts and winners of their groups are
combined before the shuffle, and only rows of groups of several are looked up in them.

Texts are equal when identical after deleting every ``[\\x20\\x09-\\x0D]``; null counts as empty, so null, empty and
blank texts form one group. Of equal texts stays the row with the most code points in the original text, then the
smallest doc_id (null last); of rows that tie in both, one. Empty tables give empty results. Further columns are
carried by drop_duplicates and ignored by exact_groups, whatever their names. Very long texts are read whole, and only
their digests and lengths are kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.llm.common import BLANKS, stored, table

#: A digest of more than this share of the rows is certain to be treated as frequent. At most 1/SUPPORT are tracked.
SUPPORT = 0.001


def _digest(text: Column) -> Column:
    return F.unhex(F.sha2(F.translate(F.coalesce(text, F.lit("")), BLANKS, ""), 256))


def _chars(text: Column) -> Column:
    return F.length(F.coalesce(text, F.lit("")))


def _best(chars: str, doc_id: str, tie: str) -> Column:
    """The order in which rows of a group are preferred, as one comparable value."""
    return F.struct((-F.col(chars)).alias("less"), F.col(doc_id).isNull().alias("no_id"), F.col(doc_id).alias("id"), F.col(tie).alias("tie"))


def heavy_winners(keyed: DataFrame, support: float = SUPPORT) -> DataFrame:
    """Of rows (__digest, __chars, __id, __tie): (__digest, __n, __best) of the digests that may be frequent.

    DataFrame.freqItems is a Misra-Gries summary of 1/support counters, combined over partitions; it may name
    infrequent digests too. Their counts and winners are exact, from a second pass over the named digests only.
    """
    named = keyed.select(F.xxhash64("__digest").alias("__k")).freqItems(["__k"], support)
    named = named.select(F.explode("__k_freqItems").alias("__k")).distinct()
    hot = keyed.withColumn("__k", F.xxhash64("__digest")).join(F.broadcast(named), "__k", "left_semi")
    return hot.groupBy("__digest").agg(F.count("*").alias("__n"), F.min(_best("__chars", "__id", "__tie")).alias("__best")).where("__n > 1")


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256.

    The texts are read once: digests and lengths are stored, and all further passes read those.
    """
    keyed = docs.select(F.col(id_col).alias("__id"), _digest(F.col(text_col)).alias("__digest"), _chars(F.col(text_col)).alias("__chars"), F.monotonically_increasing_id().alias("__tie"))
    keyed = stored(keyed, "digests")
    winners = stored(heavy_winners(keyed), "winners")
    out = [F.col("__id").alias("doc_id"), F.col("__keep").alias("keep_id"), F.col("__n").cast("long").alias("group_size"), F.col("__kept").alias("kept"), F.lower(F.hex("__digest")).alias("text_sha256")]
    hot = keyed.join(F.broadcast(winners), "__digest").withColumn("__keep", F.col("__best.id")).withColumn("__kept", F.col("__tie") == F.col("__best.tie"))
    rest = keyed.join(F.broadcast(winners.select("__digest")), "__digest", "left_anti")
    groups = rest.groupBy("__digest").agg(F.count("*").alias("__n"), F.min(_best("__chars", "__id", "__tie")).alias("__best")).where("__n > 1")
    groups = stored(groups, "groups").withColumnRenamed("__digest", "__of")
    rest = rest.join(groups, rest["__digest"] == groups["__of"], "left")
    rest = rest.withColumn("__keep", F.when(F.col("__of").isNull(), F.col("__id")).otherwise(F.col("__best.id"))).withColumn("__kept", F.col("__of").isNull() | (F.col("__tie") == F.col("__best.tie"))).withColumn("__n", F.coalesce("__n", F.lit(1)))
    return hot.select(*out).unionAll(rest.select(*out))


def drop_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with all its columns, one row for each text.

    Losers of hot groups are dropped where they are read; what is left is ranked within its digest, with the rank's
    limit applied before the shuffle too, so rows that tie in everything don't meet in one task either.
    """
    names = docs.columns
    text = F.col(text_col)
    wide = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("__row"), F.col(id_col).alias("__id"), _digest(text).alias("__digest"), _chars(text).alias("__chars"), F.lit(0).alias("__tie"))
    winners = stored(heavy_winners(stored(wide.drop("__row"), "digests")), "winners")
    best = winners.select("__digest", F.col("__best.less").alias("__less"), F.col("__best.id").alias("__win"))
    wide = wide.join(F.broadcast(best), "__digest", "left")
    lost = F.col("__less").isNotNull() & ~((F.col("__less") == -F.col("__chars")) & F.col("__win").eqNullSafe(F.col("__id")))
    order = Window.partitionBy("__digest").orderBy(F.desc("__chars"), F.asc_nulls_last("__id"))
    left = wide.where(~lost).withColumn("__rank", F.row_number().over(order)).where("__rank = 1")
    return left.select(*[F.col("__row").getField(c).alias(c) for c in names])


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(table(spark, sf_dir, "documents"))


SQL = {
    "op8_exact_dedup": r"""
WITH k AS (SELECT doc_id, length(coalesce(text, '')) AS n, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS h FROM documents)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY h) AS group_size,
       row_number() OVER w = 1 AS kept, h AS text_sha256
FROM k WINDOW w AS (PARTITION BY h ORDER BY n DESC, doc_id ASC NULLS LAST)""",
}
QUERIES = {"op8_exact_dedup": op8_exact_dedup}
