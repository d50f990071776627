"""Contiguous, byte-balanced shards by global prefix sums (DataFrame operations only).

Rows are dealt into sorted ranges of (id, checksum). A total for each range gives, by a prefix sum over the ranges,
the byte and row position at which it starts; a prefix sum inside each range does the rest. A row goes to the
shard in whose n-th part of all bytes its middle byte lies: shards are contiguous in the order of the ids and each
holds its n-th of the bytes, give or take a row at either end.

Nulls: a null text has 0 bytes and the checksum of an empty text; null ids come first. Repeated rows are rows like
all others. An empty table gives an empty result. A very long text counts with all its bytes; only its size and checksum are
shuffled. Further columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.llm.common import stored, table

#: What a row costs beside its text, in bytes.
OVERHEAD = 8
#: Rows of a sorted range, in large tables.
RANGE_ROWS = 500_000


def byte_shards(docs: DataFrame, shards: int = 24, id_col: str = "doc_id", text_col: str = "text", ranges: int | None = None) -> DataFrame:
    """One row per row of docs: doc_id, size, text_crc32, shard, slot (gapless from 0 in each shard).

    ranges is the number of sorted ranges (one for RANGE_ROWS rows, but not less than Spark's shuffle partitions, if null). Only totals of the ranges, one row
    each, and first rows of the shards are broadcast: their numbers are parameters and don't grow with the data.
    """
    spark = docs.sparkSession
    ranges = ranges or max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-docs.count() // RANGE_ROWS))
    text = F.coalesce(F.col(text_col), F.lit(""))
    narrow = docs.select(F.col(id_col).alias("doc_id"), (F.octet_length(text) + OVERHEAD).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.monotonically_increasing_id().alias("tie"))
    # The tie lets a range end between rows of the same id, so that one id can't fill a task.
    dealt = narrow.repartitionByRange(ranges, F.asc_nulls_first("doc_id"), "text_crc32", "tie").withColumn("part", F.spark_partition_id())
    dealt = stored(dealt, "ranges")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    totals = dealt.groupBy("part").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"))
    starts = totals.select("part", F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("byte0"), F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("row0"), F.sum("bytes").over(Window.partitionBy()).alias("all_bytes"))
    inside = Window.partitionBy("part").orderBy(F.asc_nulls_first("doc_id"), "text_crc32", "tie").rowsBetween(Window.unboundedPreceding, 0)
    placed = dealt.withColumn("upto", F.sum("size").over(inside)).withColumn("nth", F.count("*").over(inside)).join(F.broadcast(starts), "part")
    placed = placed.withColumn("row", F.col("row0") + F.col("nth") - 1).withColumn("shard", F.expr(f"cast(least({shards - 1}, ((2 * (byte0 + upto) - size) * {shards}) div (2 * all_bytes)) as int)"))
    placed = stored(placed.select("doc_id", "size", "text_crc32", "shard", "row"), "placed")
    first = placed.groupBy("shard").agg(F.min("row").alias("row1"))
    return placed.join(F.broadcast(first), "shard").select("doc_id", "size", "text_crc32", "shard", (F.col("row") - F.col("row1")).alias("slot"))


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = byte_shards(table(spark, sf_dir, "documents"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


#: The checksum's table is made by its rule; texts are folded byte by byte.
SQL: dict[str, str] = {
    "op10_sharding": r"""
WITH RECURSIVE t(i, c, k) AS (SELECT i, i, 0 FROM range(256) r(i) UNION ALL SELECT i, CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM t WHERE k < 8),
tab AS (SELECT list(c ORDER BY i) AS tab FROM t WHERE k = 8),
h AS (SELECT doc_id, hex(coalesce(text, '')) AS x FROM documents),
d AS (SELECT doc_id, (length(x) // 2 + 8)::BIGINT AS size, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(length(x) // 2), lambda i: ('0x' || substr(x, 2 * i + 1, 2))::BIGINT)), lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1])), 4294967295) AS text_crc32 FROM h, tab),
s AS (SELECT *, least(23, ((2 * sum(size) OVER (ORDER BY doc_id NULLS FIRST, text_crc32 ROWS UNBOUNDED PRECEDING) - size) * 24) // (2 * sum(size) OVER ()))::INT AS shard FROM d)
SELECT doc_id, size, text_crc32, 'bytes' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY doc_id NULLS FIRST, text_crc32) - 1 AS slot, NULL::INT AS grown_shard FROM s""",
}
QUERIES = {"op10_sharding": op10_sharding}
