"""Hard negatives by a two-dimensional block matrix product.

The product of anchors and rows is cut like SUMMA's: both sides into blocks of rows, and the dimensions into chunks. A task
multiplies one block of anchors with one block of rows over one chunk, which gives a partial tile of int64 scores; the partial
tiles of a pair of blocks are shuffled together and added; the finished tile is reduced where it lies to the best few of each anchor, and only
those go on. No task sees more than one pair of blocks, and no pair of rows leaves its tile unless it is among the best.

Rows are blocked by groups of labels. Tiles of equal groups give the positives: the first rows of the anchor's own label.
Tiles of all pairs of blocks, but those that hold one and the same label only, give the negatives: with the positives known, each tile is cut to
each positive's window of scores. So if groups hold one label each, every score is made once.

The number of scores is anchors times rows by the contract, and grows with the square of the table; tasks grow in number, not in size.

Components are floor(scale * x), x as double, held to 2^28 in size (x to 2^20 at a scale of 256), so that sums over up to 128 dimensions
of that size, and over any number of usual ones, are exact in 64 bits. Vectors of different lengths count as filled up with zeros. Rows
whose id, label or vector is null, or with a null or non-finite component, take no part; empty and zero vectors do. A repeated row is a row of its own: it may be
a positive of its copy, and an anchor too. Ties go to the smaller id. Fewer positives or negatives than asked for are all returned; an
anchor without any has no rows. An empty table gives an empty result. Further columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.llm.common import ship, stored, table

#: Rows and anchors of a block, on average.
ROWS = 4096
ANCHORS = 128
#: Dimensions of a chunk, unless there were more than CHUNKS of them.
DIMS = 32
CHUNKS = 8
#: Labels are dealt into so many groups. Their sizes, one row each, are what the driver sees.
GROUPS = 64
#: Components are held to this size.
MOST = 2**28

TILE = "part_a int, part_r int, chunk int, anchor_key array<long>, anchor_label array<long>, positives array<array<struct<nth:int,id:long,score:long>>>, key array<long>, id array<long>, label array<long>, scores binary"


def prepared(vectors: DataFrame, is_anchor: Callable[[Column], Column], label: Callable[[Column, Column], Column], scale: int, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """Stored rows (key, id, label, group, anchor, v) that take part, v in whole numbers; key is a number of the row."""
    v = F.col("v")
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), F.col(vector_col).cast("array<double>").alias("v"))
    rows = rows.where(F.col("id").isNotNull() & F.col("label").isNotNull() & v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))
    whole = F.transform(v, lambda x: F.floor(F.greatest(F.lit(-float(MOST)), F.least(F.lit(float(MOST)), x * scale))).cast("int"))
    rows = rows.select(F.monotonically_increasing_id().alias("key"), "id", label(F.col("id"), F.col("label")).cast("long").alias("label"), is_anchor(F.col("id")).alias("anchor"), whole.alias("v"))
    return stored(rows.withColumn("group", F.pmod(F.xxhash64("label"), F.lit(GROUPS)).cast("int")), "rows")


def block_plan(rows: DataFrame) -> list[tuple]:
    """(group, only label or null, first row block, row blocks, first anchor block, anchor blocks): at most GROUPS of them."""
    sizes = rows.groupBy("group").agg(F.count("*").alias("n"), F.count_if("anchor").alias("anchors"), F.min("label").alias("low"), F.max("label").alias("high"))
    plan, at_r, at_a = [], 0, 0
    for g in sizes.orderBy("group").collect():
        r, a = -(-g.n // ROWS), -(-g.anchors // ANCHORS)
        plan.append((g.group, g.low == g.high, at_r, r, at_a, a))
        at_r, at_a = at_r + r, at_a + a
    return plan


def _every(first: Column, n: Column) -> Column:
    """first and the n - 1 numbers after it, one row each; no row if n is 0."""
    return F.explode(F.when(n > 0, F.sequence(first.cast("int"), (first + n - 1).cast("int"))))


def tiles(anchors: DataFrame, rows: DataFrame, plan: DataFrame, dims: int, same: bool) -> DataFrame:
    """Partial tiles of the pairs of blocks: those of equal groups, or all but those of one and the same label.

    anchors (key, label, group, v, positives) and rows are copied to the blocks that they meet, a chunk of dimensions each.
    """
    step = max(DIMS, -(-dims // CHUNKS))
    chunks = max(1, -(-dims // step))
    lay = lambda of, n: F.pmod(F.xxhash64(of, F.lit(5)), n)
    a = anchors.join(F.broadcast(plan), "group").withColumn("part_a", (F.col("first_a") + lay("key", F.col("blocks_a"))).cast("int"))
    r = rows.join(F.broadcast(plan), "group").withColumn("part_r", (F.col("first_r") + lay("key", F.col("blocks_r"))).cast("int"))
    if same:
        a = a.withColumn("part_r", _every(F.col("first_r"), F.col("blocks_r")))
        r = r.where("blocks_a > 0").withColumn("part_a", _every(F.col("first_a"), F.col("blocks_a")))
    else:
        all_r, all_a = plan.agg(F.sum("blocks_r"), F.sum("blocks_a")).first()
        a = a.withColumn("part_r", _every(F.lit(0), F.lit(all_r))).where("not (pure and part_r >= first_r and part_r < first_r + blocks_r)")
        r = r.withColumn("part_a", _every(F.lit(0), F.lit(all_a))).where("not (pure and part_a >= first_a and part_a < first_a + blocks_a)")
    cut = lambda df, *cols: df.withColumn("chunk", _every(F.lit(0), F.lit(chunks))).select("part_a", "part_r", "chunk", *cols, F.slice("v", F.col("chunk") * step + 1, step).alias("v"))
    # What the reduction needs beside the scores goes with the first chunk.
    once = lambda c: F.when(F.col("chunk") == 0, F.col(c)).alias(c)
    a, r = cut(a, "key", "label", once("positives")), cut(r, "key", "id", "label")
    a = a.toDF(*a.columns)
    keys = ["part_a", "part_r", "chunk"]

    def multiply(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        i, j, k = (x.as_py() for x in key)
        if not len(left) or not len(right):
            return pa.table({c: [] for c in NAMES}, schema=SCHEMA)
        # The order of rows is the same in all chunks of a pair of blocks.
        left, right = left.sort_by("key"), right.sort_by("key")
        score = product(_matrix(left["v"], step), _matrix(right["v"], step))
        out: dict = {"part_a": i, "part_r": j, "chunk": k, "scores": score.tobytes()}
        for to, col in (("anchor_key", left["key"]), ("anchor_label", left["label"]), ("positives", left["positives"]), ("key", right["key"]), ("id", right["id"]), ("label", right["label"])):
            out[to] = col.to_pylist() if k == 0 else None
        return pa.Table.from_pylist([out], schema=SCHEMA)

    return a.groupBy(*keys).cogroup(r.groupBy(*keys)).applyInArrow(multiply, TILE)


_POSITIVE = pa.struct([("nth", pa.int32()), ("id", pa.int64()), ("score", pa.int64())])
_LONGS = pa.list_(pa.int64())
SCHEMA = pa.schema([("part_a", pa.int32()), ("part_r", pa.int32()), ("chunk", pa.int32()), ("anchor_key", _LONGS), ("anchor_label", _LONGS), ("positives", pa.list_(pa.list_(_POSITIVE))), ("key", _LONGS), ("id", _LONGS), ("label", _LONGS), ("scores", pa.binary())])
NAMES = SCHEMA.names


def _matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    """Lists of at most width whole numbers as rows of a matrix, filled up with zeros."""
    column = column.combine_chunks()
    sizes = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    out = np.zeros((len(column), width), np.int64)
    out[np.repeat(np.arange(len(column)), sizes), np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = column.flatten().to_numpy(zero_copy_only=False)
    return out


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a times b transposed, exact in int64. Where every sum stays below 2^53, doubles are exact too, and faster."""
    if int(np.abs(a).max(initial=0)) * int(np.abs(b).max(initial=0)) * a.shape[1] < 2**53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a @ b.T


def _added(parts: Iterator[pa.RecordBatch]) -> tuple[dict, np.ndarray]:
    """The sum of a pair of blocks' partial tiles, one at a time, and what came with the first chunk."""
    head, total = {}, None
    for batch in parts:
        for row in range(len(batch)):
            part = np.frombuffer(batch.column("scores")[row].as_buffer(), np.int64)
            total = part.copy() if total is None else np.add(total, part, out=total)
            if batch.column("chunk")[row].as_py() == 0:
                head = {c: batch.column(c)[row].as_py() for c in NAMES[3:-1]}
    return head, total.reshape(len(head["anchor_key"]), len(head["key"]))


def top(score: np.ndarray, ids: np.ndarray, some: np.ndarray, k: int) -> np.ndarray:
    """The first k of some, by score, then id."""
    if len(some) > k:
        least = np.partition(score[some], len(some) - k)[len(some) - k]
        above, level = some[score[some] > least], some[score[some] == least]
        # Of those that tie with the last, the smallest ids only.
        need = k - len(above)
        if len(level) > need:
            level = level[np.argpartition(ids[level], need - 1)[:need]]
        some = np.concatenate([above, level])
    return some[np.lexsort((ids[some], -score[some]))]


def positive_tops(k: int) -> Callable:
    def reduce(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, score = _added(parts)
        key, ids, label = (np.array(head[c], np.int64) for c in ("key", "id", "label"))
        out: list[list] = [[], [], [], []]
        for n, (anchor, of) in enumerate(zip(head["anchor_key"], head["anchor_label"])):
            best = top(score[n], ids, np.flatnonzero((label == of) & (key != anchor)), k)
            for c, values in zip(out, ([anchor] * len(best), key[best].tolist(), ids[best].tolist(), score[n, best].tolist())):
                c += values
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], names=["anchor", "key", "id", "score"])

    return reduce


def negative_tops(k: int, least: int, most: int) -> Callable:
    def reduce(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, score = _added(parts)
        key, ids, label = (np.array(head[c], np.int64) for c in ("key", "id", "label"))
        out: list[list] = [[], [], [], [], []]
        for n, (anchor, of, positives) in enumerate(zip(head["anchor_key"], head["anchor_label"], head["positives"])):
            other = np.flatnonzero(label != of)
            found = score[n, other]
            for p in positives or ():
                # least * positive <= 100 * negative <= most * positive, in Python's whole numbers.
                low, high = -(-least * p["score"] // 100), most * p["score"] // 100
                best = top(score[n], ids, other[(found >= low) & (found <= high)], k) if low <= high else other[:0]
                for c, values in zip(out, ([anchor] * len(best), [p["nth"]] * len(best), key[best].tolist(), ids[best].tolist(), score[n, best].tolist())):
                    c += values
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], names=["anchor", "nth", "key", "id", "score"])

    return reduce


def mine(
    vectors: DataFrame,
    is_anchor: Callable[[Column], Column],
    label: Callable[[Column, Column], Column] = lambda i, x: x,
    positives: int = 5,
    negatives: int = 10,
    least: int = 30,
    most: int = 90,
    scale: int = 256,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
) -> DataFrame:
    """Rows (anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    An anchor is a row for which is_anchor(id) holds; label(id, label) is the label that counts. Negatives lie between least
    and most per cent of the positive's score.
    """
    spark = vectors.sparkSession
    ship(spark)
    rows = prepared(vectors, is_anchor, label, scale, id_col, vector_col, label_col)
    dims = rows.agg(F.max(F.size("v"))).first()[0] or 0
    plan = spark.createDataFrame(block_plan(rows), "group int, pure boolean, first_r int, blocks_r int, first_a int, blocks_a int")
    anchors = rows.where("anchor")
    pair = ["part_a", "part_r"]

    made = tiles(anchors.withColumn("positives", F.lit(None).cast("array<struct<nth:int,id:long,score:long>>")), rows, plan, dims, same=True)
    found = made.groupBy(*pair).applyInArrow(positive_tops(positives), "anchor long, key long, id long, score long")
    order = Window.partitionBy("anchor").orderBy(F.desc("score"), "id", "key")
    found = found.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= positives)
    known = stored(found.groupBy("anchor").agg(F.array_sort(F.collect_list(F.struct("nth", "id", "score"))).alias("positives")), "positives")

    ready = anchors.join(known, anchors["key"] == known["anchor"], "left").drop(known["anchor"])
    ready = stored(ready, "anchors")
    made = tiles(ready, rows, plan, dims, same=False)
    found = made.groupBy(*pair).applyInArrow(negative_tops(negatives, least, most), "anchor long, nth long, key long, id long, score long")
    order = Window.partitionBy("anchor", "nth").orderBy(F.desc("score"), "id", "key")
    found = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= negatives)
    of = ready.select(F.col("key").alias("anchor"), F.col("id").alias("anchor_id"), F.explode("positives").alias("p"))
    of = of.select("anchor", "anchor_id", F.col("p.nth").cast("long").alias("nth"), F.col("p.id").alias("positive_id"), F.col("p.score").alias("positive_score"))
    return found.join(of, ["anchor", "nth"]).select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    moved = lambda i, label: F.when(i % 7 == 0, (label + 1) % 10).otherwise(label)
    return mine(table(spark, sf_dir, "embeddings"), lambda i: i % 100 == 0, moved)


SQL = {
    "op12_hard_negatives": """
WITH e AS (SELECT row_number() OVER () AS r, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.r AS ar, a.vec_id AS anchor_id, b.r AS br, b.vec_id AS other, a.label = b.label AS same, list_inner_product(a.v::DOUBLE[], b.v::DOUBLE[])::BIGINT AS score FROM e a JOIN e b ON a.vec_id % 100 = 0 AND a.r <> b.r),
p AS (SELECT ar, br, anchor_id, other AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY ar ORDER BY score DESC, other, br) <= 5),
n AS (SELECT p.anchor_id, positive_id, row_number() OVER (PARTITION BY p.ar, p.br ORDER BY score DESC, other, s.br)::INT AS rank, other AS negative_id, positive_score, score AS negative_score
  FROM p JOIN s ON s.ar = p.ar AND NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score)
SELECT * FROM n WHERE rank <= 10""",
}
QUERIES = {"op12_hard_negatives": op12_hard_negatives}
