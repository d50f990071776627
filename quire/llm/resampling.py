"""Importance resampling of documents towards a target distribution of hashed word n-grams.

DuckDB runs inside each partition: SQL takes the words of a slice of the partition's texts (unnest), forms runs of 1 to n
consecutive words (windows), and counts them by bucket, where the bucket comes from a registered function, zlib's CRC. The counts
of each document are spilled to Parquet, in the folder that the cluster shares; the texts aren't read again. Spark merges the
spilled counts into totals of each bucket (at most BUCKETS rows, broadcast), turns these into gains, and scores the documents.

Documents are drawn by the largest of weight plus Gumbel noise, which is sampling without replacement in proportion to
exp(weight). The noise comes from a hash of the id, so reruns agree. Ranks are prefix sums over sorted ranges: no task sorts
all documents, and equal scores or repeated ids don't meet in one.

A slice holds SLICE_BYTES of text, or one longer document; within a slice DuckDB keeps to MEMORY and spills to a folder of the
task, which it deletes. Nulls: a null text has no words; a null id counts as an empty one and comes last among ties. Empty texts and texts without
words have weight 0. Repeated rows are rows like all others, each with a result. An empty table gives an empty result; an empty
target has no features (T = 0). Very long texts are read whole. Further columns are ignored, whatever their names.
"""

from __future__ import annotations

import tempfile
import zlib
from collections.abc import Iterator

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.llm.common import ship, stored, table

BUCKETS = 10_000
#: Bytes of text that one SQL statement reads, if no single document has more.
SLICE_BYTES = 1 << 20
MEMORY = "200MB"
#: Rows of a sorted range, in large tables.
RANGE_ROWS = 500_000
#: What is no part of a word: ASCII but for digits and letters.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def _grams(longest: int) -> str:
    """SQL for the runs of 1 to longest words of each document."""
    runs = ["SELECT doc, word AS gram FROM words"]
    for n in range(2, longest + 1):
        run = " || ' ' || ".join(["word"] + [f"lead(word, {k}) OVER w" for k in range(1, n)])
        runs.append(f"SELECT doc, {run} AS gram FROM words WINDOW w AS (PARTITION BY doc ORDER BY nth)")
    return " UNION ALL ".join(runs)


def counting_sql(longest: int, buckets: int) -> str:
    """Rows (doc, n_words, n_features, buckets, counts) of a table slice (doc, text), in the order of doc.

    Only ASCII letters are lower-cased.
    """
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return rf"""
WITH lists AS (SELECT doc, regexp_extract_all(translate(text, '{upper}', '{lower}'), '{WORD}') AS list FROM slice),
words AS (SELECT doc, unnest(list) AS word, unnest(range(len(list))) AS nth FROM lists),
grams AS ({_grams(longest)}),
counted AS (SELECT doc, gram, count(*) AS n FROM grams WHERE gram IS NOT NULL GROUP BY ALL),
hashed AS (SELECT gram, (crc(gram) % {buckets})::INT AS bucket FROM (SELECT DISTINCT gram FROM counted)),
filled AS (SELECT doc, bucket, sum(n)::BIGINT AS n FROM counted JOIN hashed USING (gram) GROUP BY ALL),
packed AS (SELECT doc, sum(n)::BIGINT AS n_features, list(bucket ORDER BY bucket) AS buckets, list(n ORDER BY bucket) AS counts FROM filled GROUP BY doc)
SELECT doc, len(list)::BIGINT AS n_words, coalesce(n_features, 0) AS n_features, coalesce(buckets, []) AS buckets, coalesce(counts, []) AS counts
FROM lists LEFT JOIN packed USING (doc) ORDER BY doc"""


def _crc(grams: pa.ChunkedArray) -> pa.Array:
    return pa.array([zlib.crc32(g.encode()) for g in grams.to_pylist()], pa.int64())


def _slices(batch: pa.RecordBatch, of: int) -> Iterator[pa.RecordBatch]:
    """Runs of rows with at most of bytes of text, or one row."""
    upto = np.cumsum(pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False))
    at = 0
    while at < len(batch):
        end = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + of, side="right")))
        yield batch.slice(at, end - at)
        at = end


def bucket_counts(docs: DataFrame, longest: int = 1, buckets: int = BUCKETS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One stored row per row of docs: doc_id, n_words, n_features, buckets, counts (of its features, by bucket)."""
    spark = docs.sparkSession
    ship(spark)
    sql = counting_sql(longest, buckets)
    taken = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    kinds = pa.schema([("n_words", pa.int64()), ("n_features", pa.int64()), ("buckets", pa.list_(pa.int32())), ("counts", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with tempfile.TemporaryDirectory() as own, duckdb.connect(config={"threads": 1, "memory_limit": MEMORY, "temp_directory": own}) as db:
            db.create_function("crc", _crc, ["VARCHAR"], "BIGINT", type="arrow")
            for batch in batches:
                for part in _slices(batch, SLICE_BYTES):
                    db.register("slice", pa.table({"doc": pa.array(range(len(part)), pa.int64()), "text": part.column("text")}))
                    found = db.sql(sql).to_arrow_table().select(kinds.names).cast(kinds).combine_chunks()
                    db.unregister("slice")
                    yield pa.RecordBatch.from_arrays([part.column("doc_id"), *[c.combine_chunks() for c in found.columns]], names=["doc_id", *kinds.names])

    made = taken.mapInArrow(run, f"doc_id {taken.schema['doc_id'].dataType.simpleString()}, n_words long, n_features long, buckets array<int>, counts array<long>")
    return stored(made, "bucket_counts")


def _totals(spilled: DataFrame) -> DataFrame:
    pairs = spilled.select(F.explode(F.arrays_zip("buckets", "counts")).alias("x"))
    return pairs.groupBy(F.col("x.buckets").alias("bucket")).agg(F.sum("x.counts").alias("n"))


def bucket_gains(spilled: DataFrame, wanted: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, gain) of all buckets: by how much likelier a feature is in wanted, 1000 times the logarithm, floored."""
    ours, theirs = _totals(spilled).withColumnRenamed("n", "s"), _totals(wanted).withColumnRenamed("n", "t")
    both = spilled.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket")).join(ours, "bucket", "left").join(theirs, "bucket", "left").na.fill(0)
    every = Window.partitionBy()
    both = both.withColumn("all_s", F.sum("s").over(every)).withColumn("all_t", F.sum("t").over(every))
    ratio = ((F.col("t") + 1).cast("double") * (F.col("all_s") + buckets)) / ((F.col("s") + 1).cast("double") * (F.col("all_t") + buckets))
    return stored(both.select("bucket", F.floor(F.log(ratio) * 1000).alias("gain")), "gains")


def _noise(doc_id: Column, seed: str) -> Column:
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.log(-F.log((h + 0.5) / 4294967296.0)) * -1000.0)


def scored(docs: DataFrame, target: DataFrame, longest: int = 1, buckets: int = BUCKETS, seed: str = "2024", id_col: str = "doc_id", text_col: str = "text", target_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, n_words, n_features, weight, score, tie (a number of the row)."""
    spilled = bucket_counts(docs, longest, buckets, id_col, text_col).withColumn("tie", F.monotonically_increasing_id())
    wanted = bucket_counts(target.select(F.lit(0).alias("doc_id"), F.col(target_col).alias("text")), longest, buckets)
    gains = bucket_gains(spilled, wanted, buckets)
    pairs = spilled.select("tie", F.explode(F.arrays_zip("buckets", "counts")).alias("x")).select("tie", F.col("x.buckets").alias("bucket"), F.col("x.counts").alias("n"))
    # Each document's rows lie in one partition: what is shuffled is one sum for each document.
    sums = pairs.join(F.broadcast(gains), "bucket").groupBy("tie").agg(F.sum(F.col("gain") * F.col("n")).alias("sum"))
    found = spilled.select("doc_id", "n_words", "n_features", "tie").join(sums, "tie", "left").withColumn("sum", F.coalesce("sum", F.lit(0)))
    # Floored division of whole numbers: the remainder goes first.
    weight = F.when(F.col("n_features") > 0, F.expr("(sum - pmod(sum, n_features)) div n_features")).otherwise(F.lit(0).cast("long"))
    found = found.withColumn("weight", weight)
    return stored(found.select("doc_id", "n_words", "n_features", "weight", (F.col("weight") + _noise(F.col("doc_id"), seed)).alias("score"), "tie"), "scores")


def ranked(scores: DataFrame, percent: int = 10, least_words: int = 20, ranges: int | None = None) -> DataFrame:
    """scores with a rank for the drawn ones: the given percentage of the rows with enough words, by score, then id."""
    spark = scores.sparkSession
    enough = F.col("n_words") >= least_words
    n = scores.where(enough).count()
    drawn = percent * n // 100
    order = [F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("tie")]
    ranges = ranges or max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n // RANGE_ROWS))
    dealt = stored(scores.where(enough).repartitionByRange(ranges, *order).withColumn("part", F.spark_partition_id()), "ranges")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = dealt.groupBy("part").agg(F.count("*").alias("rows")).select("part", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("start"))
    # One row a range.
    placed = dealt.join(F.broadcast(starts), "part").where(F.col("start") < drawn)
    placed = placed.withColumn("rank", F.col("start") + F.row_number().over(Window.partitionBy("part").orderBy(*order))).where(F.col("rank") <= drawn)
    return scores.join(placed.select("tie", "rank"), "tie", "left")


def op13_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return ranked(scores).select("doc_id", "n_features", "weight", "score", F.col("rank").cast("long").alias("rank"))


#: The checksum's table is made by its rule; each different word is folded once.
SQL = {
    "op13_resampling": r"""
WITH RECURSIVE t(i, c, k) AS (SELECT i, i, 0 FROM range(256) r(i) UNION ALL SELECT i, CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM t WHERE k < 8),
tab AS (SELECT list(c ORDER BY i) AS tab FROM t WHERE k = 8),
d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS l FROM documents),
dw AS (SELECT r, unnest(l) AS w FROM d),
bw AS (SELECT unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS w FROM benchmark),
hx AS (SELECT w, hex(w) AS x FROM (SELECT w FROM dw UNION SELECT w FROM bw)),
h AS (SELECT w, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(length(x) // 2), lambda i: ('0x' || substr(x, 2 * i + 1, 2))::BIGINT)), lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1])), 4294967295) % 10000 AS k FROM hx, tab),
s AS (SELECT k, count(*) AS s FROM dw JOIN h USING (w) GROUP BY k), tt AS (SELECT k, count(*) AS t FROM bw JOIN h USING (w) GROUP BY k),
g AS (SELECT k, floor(1000 * ln(((coalesce(t, 0) + 1)::DOUBLE * ((SELECT count(*) FROM dw) + 10000)) / ((coalesce(s, 0) + 1)::DOUBLE * ((SELECT count(*) FROM bw) + 10000))))::BIGINT AS gain FROM s FULL JOIN tt USING (k)),
m AS (SELECT r, floor(sum(gain)::DOUBLE / count(*))::BIGINT AS weight FROM dw JOIN h USING (w) JOIN g USING (k) GROUP BY r),
f AS (SELECT d.r, doc_id, len(l)::BIGINT AS n_features, coalesce(weight, 0) AS weight,
      coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score FROM d LEFT JOIN m USING (r)),
k AS (SELECT r, row_number() OVER (ORDER BY score DESC, doc_id ASC NULLS LAST) AS nth FROM f WHERE n_features >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN nth <= 10 * (SELECT count(*) FROM k) // 100 THEN nth END AS rank FROM f LEFT JOIN k USING (r)""",
}
QUERIES = {"op13_resampling": op13_resampling}
