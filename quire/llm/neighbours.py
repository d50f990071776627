"""Approximate nearest neighbours with balanced posting lists.

Centroids come from a bounded, hash-chosen sample of the vectors, by halving: each set is cut at the median of its
projection on the line between two far centres, so lists are equally long. Where the table is so large that lists would be
longer than LIST_SIZE, each list is halved again in the same way, on the executors, from at most SAMPLE_OF_LIST of its
vectors. Lists that are still too long are cut in place, round after round: their own few centroids aren't gathered anywhere, a list's vectors
and queries meet them where the list is. So there is no limit to the number of lists, and their length doesn't grow. All vectors are then assigned: a vector near a boundary is put into several lists. For that, centroids are searched
with a graph that links each to its nearest ones, by best-first search; it lies in memory, broadcast, at most
LISTS x SPLITS x (dimensions + LINKS) numbers. A query reads its FEWEST nearest lists and all whose centroid is at most RATIO times as far as its
nearest one, however many these are: the search's beam is widened until it holds a centroid beyond the ratio.

Halving numbers lists so that neighbours in number are neighbours in space. SPAN lists in a row are searched together, in
one task: a vector that stands in several of them is compared once, and a query gives its best ones of all of them. Many
vectors of such a span are cut into blocks of bounded size, and so are its queries. Distances are exact, in double precision,
on original vectors.

Copies of a vector are searched as one: of equal vectors only the k + 1 smallest ids can appear in a result, and equal
queries share one search. Thus a vector that a third of all rows repeat costs as much as any other.

Vectors that are null, zero, or have null or non-finite components take no part, neither do those whose length is not the
most frequent one (the shorter of equally frequent ones). Rows with null ids take no part. Ties go to the smaller id. With
fewer candidates than k all are found. An empty table gives an empty result. Further columns are ignored, whatever their
names. A repeated id with the same vector is one row; with different vectors, each of them is a candidate.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.llm.common import hash_sample, ship, stored, table

#: Vectors that the centroids are fitted on, at most.
SAMPLE = 20_000
#: Lists of the first halving, at most, and how many each of them is cut into in a large table, at most.
LISTS = 1024
SPLITS = 64
#: Vectors of a list, if the table isn't larger than LISTS * SPLITS lists of that size; copies of boundary vectors not counted.
LIST_SIZE = 128
#: Vectors of a list that its second halving is fitted on, at most.
SAMPLE_OF_LIST = 4096
#: Links of a centroid in the graph, and how many centroids a search keeps in view at first.
LINKS = 16
BEAM = 32
#: Beyond RUN * RUNS centroids, a centroid is linked within the RUNS runs of RUN centroids that are nearest to its own.
RUN, RUNS = 128, 32
#: A vector goes to lists whose centroid is at most so many times as far as the nearest, COPIES at most.
NEAR = 1.10
COPIES = 4
#: Copies of a vector in each later round of cutting lists in place.
COPIES_BELOW = 2
#: A query reads lists whose centroid is at most so many times as far as the nearest, and its FEWEST nearest ones in any case.
RATIO = 1.13
FEWEST = 8
#: Lists that are searched together, vectors of a block of them, and queries that meet it at once, on average.
SPAN = 32
BLOCK = 4096


@dataclass
class Graph:
    """Centroids and, for each, the nearest others."""

    centroids: np.ndarray
    links: np.ndarray

    @staticmethod
    def of(centroids: np.ndarray, links: int = LINKS) -> Graph:
        """Exact links among a few thousand centroids. Among more, a centroid's candidates are those of its nearest runs of centroids:

        halving numbers them so that a run lies together in space.
        """
        n = len(centroids)
        k = max(min(links, n - 1), 0)
        near = np.zeros((n, k), np.int32)
        runs = np.array_split(np.arange(n), 1 if n <= RUN * RUNS else -(-n // RUN))
        means = np.array([centroids[r].mean(axis=0) for r in runs])
        for of, r in enumerate(runs):
            at = np.argsort(_squares(means[of : of + 1], means)[0], kind="stable")[:RUNS]
            some = np.sort(np.concatenate([runs[i] for i in at]))
            for i in range(0, len(r) if k else 0, 512):
                rows = r[i : i + 512]
                d = _squares(centroids[rows], centroids[some])
                d[np.arange(len(rows)), np.searchsorted(some, rows)] = np.inf
                first = np.argpartition(d, k - 1, axis=1)[:, :k]
                order = np.argsort(np.take_along_axis(d, first, 1), axis=1, kind="stable")
                near[rows] = some[np.take_along_axis(first, order, 1)]
        return Graph(centroids, near)

    def search(self, vectors: np.ndarray, beam: int = BEAM) -> tuple[np.ndarray, np.ndarray]:
        """For each vector the beam nearest centroids found, nearest first, and their distances.

        Best-first search for many vectors at a time, from a few entry points spread over the centroids.
        """
        n, beam = len(self.centroids), min(beam, len(self.centroids))
        seeds = np.unique(np.linspace(0, n - 1, min(n, max(beam, 32))).astype(np.int64))
        ids, dists = [], []
        for at in range(0, len(vectors), 256):
            v = vectors[at : at + 256]
            d = _squares(v, self.centroids[seeds])
            top = np.argsort(d, axis=1, kind="stable")[:, :beam]
            view, dist = seeds[top], np.take_along_axis(d, top, 1)
            done = np.zeros((len(v), n), bool)
            rows = np.arange(len(v))[:, None]
            known = np.zeros((len(v), n), bool)
            known[rows, seeds[None, :]] = True
            while self.links.shape[1]:
                left = np.where(done[rows, view], np.inf, dist)
                best = left.argmin(axis=1)
                live = np.flatnonzero(np.isfinite(left[np.arange(len(v)), best]))
                if not len(live):
                    break
                node = view[live, best[live]]
                done[live, node] = True
                near = self.links[node]
                fresh = ~known[live[:, None], near]
                known[live[:, None], near] = True
                dn = np.where(fresh, ((self.centroids[near] - v[live][:, None, :]) ** 2).sum(axis=2), np.inf)
                both, ids2 = np.concatenate([dist[live], dn], axis=1), np.concatenate([view[live], near], axis=1)
                keep = np.argsort(both, axis=1, kind="stable")[:, : view.shape[1]]
                dist[live], view[live] = np.take_along_axis(both, keep, 1), np.take_along_axis(ids2, keep, 1)
            ids.append(view)
            dists.append(np.sqrt(dist))
        return (np.concatenate(ids), np.concatenate(dists)) if ids else (np.zeros((0, beam), np.int64), np.zeros((0, beam)))


    def within(self, vectors: np.ndarray, ratio: float, most: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of a vector's number and a centroid at most ratio times as far as its nearest one: most of them, or all."""
        rows, found = [], []
        left, beam = np.arange(len(vectors)), BEAM if most is None else max(BEAM, most)
        while len(left):
            ids, d = self.search(vectors[left], beam)
            near = d <= ratio * d[:, :1]
            if most is None:
                near[:, :FEWEST] = True
            # All of them are known as soon as one in view lies beyond the ratio, or none is missing.
            done = ~near[:, -1] | (ids.shape[1] >= len(self.centroids)) if most is None else np.ones(len(left), bool)
            if most is not None:
                near[:, most:] = False
            r, c = np.nonzero(near & done[:, None])
            rows.append(left[r])
            found.append(ids[r, c])
            left, beam = left[~done], 4 * beam
        return (np.concatenate(rows), np.concatenate(found)) if rows else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def _squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum((a * a).sum(1)[:, None] - 2 * a @ b.T + (b * b).sum(1)[None, :], 0)


def balanced_centroids(x: np.ndarray, lists: int, seed: int = 0) -> np.ndarray:
    """Means of lists sets of equal size (within one), found by halving."""
    rng = np.random.default_rng(seed)
    todo, out = [(np.arange(len(x)), lists)], []
    while todo:
        part, k = todo.pop()
        if k <= 1 or len(part) < 2:
            out.append(x[part].mean(axis=0))
            continue
        y = x[part]
        a, b = y[rng.integers(len(y))], y[rng.integers(len(y))]
        for _ in range(6):
            left = ((y - a) ** 2).sum(1) <= ((y - b) ** 2).sum(1)
            if left.all() or not left.any():
                break
            a, b = y[left].mean(axis=0), y[~left].mean(axis=0)
        axis = b - a if np.any(b != a) else rng.normal(size=y.shape[1])
        order = np.argsort(y @ axis, kind="stable")
        cut = len(part) * (k // 2) // k
        todo += [(part[order[:cut]], k // 2), (part[order[cut:]], k - k // 2)]
    return np.array(out)


def _stacked(vectors) -> np.ndarray:
    return np.stack([np.asarray(v, np.float64) for v in vectors])


def fit(vectors: DataFrame, n: int, sample: int = SAMPLE, lists: int | None = None) -> Graph | None:
    """The graph of centroids of the n vectors (key, v); None if there is none."""
    got = hash_sample(vectors, F.col("v"), sample).select("v").toPandas()["v"]
    if not len(got):
        return None
    x = _stacked(got)
    x = x[np.lexsort(x.T[::-1])]
    first = balanced_centroids(x, lists or int(min(LISTS, max(1, n // LIST_SIZE), len(x))))
    if lists or n <= 2 * LIST_SIZE * len(first):
        return Graph.of(first)
    # A table too large for these: each list is halved further. A list's sample is its vectors of least hash.
    graph = Graph.of(first)
    shared = vectors.sparkSession.sparkContext.broadcast((graph.centroids, graph.links))
    placed = _assigned(vectors, shared, 1.0, 1, vectors.schema["key"].dataType.simpleString(), vectors.schema["v"].dataType.simpleString())
    sizes = placed.groupBy("list").agg(F.count("*").alias("n"))
    share = F.greatest(F.lit(1.0), F.col("n") / SAMPLE_OF_LIST)
    few = placed.join(F.broadcast(sizes), "list").where(F.pmod(F.xxhash64("key", F.lit(1)), F.lit(2**30)) * share < 2**30)

    def halved(part: pd.DataFrame) -> pd.DataFrame:
        y = _stacked(part["v"].to_numpy())
        k = int(min(SPLITS, max(1, round(part["n"].iloc[0] / LIST_SIZE)), len(y)))
        return pd.DataFrame({"list": part["list"].iloc[0], "centroid": list(balanced_centroids(y[np.lexsort(y.T[::-1])], k))})

    cut = few.select("list", "n", "v").groupBy("list").applyInPandas(halved, "list int, centroid array<double>").toPandas()
    return Graph.of(_stacked(cut.sort_values("list", kind="stable")["centroid"]))


def _assigned(df: DataFrame, graph, ratio: float, most: int | None, id_type: str, vector_type: str) -> DataFrame:
    """Rows (list, key, v) of rows (key, v): each vector with the lists it belongs to or asks.

    At most `most` of the lists that the graph finds; without most, all lists within the ratio that it reaches.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g = Graph(*graph.value)
        for batch in batches:
            for at in range(0, len(batch), 2048):
                part = batch.slice(at, 2048)
                v = part.column(1)
                x = v.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(part), -1)
                rows, found = g.within(x, ratio, most)
                take = pa.array(rows)
                yield pa.RecordBatch.from_arrays([pa.array(found.astype(np.int32)), part.column(0).take(take), v.take(take)], names=["list", "key", "v"])

    return df.select("key", "v").mapInArrow(run, f"list int, key {id_type}, v {vector_type}")


def _best(lists: pd.DataFrame, queries: pd.DataFrame, k: int) -> pd.DataFrame:
    """For each query the k + 1 nearest vectors of the lists it reads; of equally near ones those with the smallest ids."""
    out: dict[str, list] = {"qkey": [], "key": [], "score": []}
    if len(lists) and len(queries):
        keys, first, which = np.unique(lists["key"].to_numpy(), return_index=True, return_inverse=True)
        x, least = _stacked(lists["v"].to_numpy()[first]), lists["least"].to_numpy()[first]
        members = {n: which[at] for n, at in lists.groupby("list").indices.items()}
        for qkey, at in queries.groupby("qkey").indices.items():
            read = [members[n] for n in queries["list"].to_numpy()[at] if n in members]
            if not read:
                continue
            some = np.unique(np.concatenate(read))
            d = np.sqrt(((x[some] - np.asarray(queries["q"].iloc[at[0]], np.float64)) ** 2).sum(axis=1))
            near = np.flatnonzero(d <= np.partition(d, k)[k]) if len(d) > k + 1 else np.arange(len(d))
            near = near[np.lexsort((least[some[near]], d[near]))[: k + 1]]
            out["qkey"] += [qkey] * len(near)
            out["key"] += list(keys[some[near]])
            out["score"] += d[near].tolist()
    return pd.DataFrame({"qkey": pd.Series(out["qkey"], dtype="object"), "key": pd.Series(out["key"], dtype="object"), "score": np.array(out["score"], float)})


def _deeper(posted: DataFrame, asking: DataFrame, ratio: float, kind: str) -> tuple[DataFrame, DataFrame]:
    """posted (list, key, v, least) and asking (list, qkey, q) with each list cut into up to SPLITS lists of its own, in place.

    A list's centroids come from its SAMPLE_OF_LIST vectors of least hash. They are joined with the blocks of the list's vectors, and with
    its queries, by the list's number.
    """
    sizes = posted.groupBy("list").agg(F.count("*").alias("n"))
    share = F.greatest(F.lit(1.0), F.col("n") / SAMPLE_OF_LIST)
    few = posted.join(sizes, "list").where(F.pmod(F.xxhash64("key", F.lit(2)), F.lit(2**30)) * share < 2**30)

    def halved(part: pd.DataFrame) -> pd.DataFrame:
        y, n = _stacked(part["v"].to_numpy()), part["n"].iloc[0]
        k = int(min(SPLITS, max(1, round(n / LIST_SIZE)), len(y)))
        return pd.DataFrame({"list": part["list"].iloc[0], "n": n, "centroids": [balanced_centroids(y[np.lexsort(y.T[::-1])], k).tolist()]})

    cut = stored(few.select("list", "n", "v").groupBy("list").applyInPandas(halved, "list long, n long, centroids array<array<double>>"), "cuts")

    def placed(rows: pd.DataFrame, cuts: pd.DataFrame, within: float, most: int, v: str) -> pd.DataFrame:
        if not len(rows) or not len(cuts):
            return rows.iloc[:0].drop(columns=["block"])
        graph = Graph.of(_stacked(cuts["centroids"].iloc[0]))
        of, sub = graph.within(_stacked(rows[v].to_numpy()), within, most)
        out = rows.drop(columns=["block"]).iloc[of].copy()
        out["list"] = out["list"].to_numpy() * SPLITS + sub
        return out

    def dealt(df: DataFrame, key: str, v: str, within: float, most: int | None, schema: str) -> DataFrame:
        counts = df.groupBy("list").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
        rows = df.join(counts, "list").withColumn("block", F.pmod(F.xxhash64(key), F.col("blocks")).cast("int")).drop("blocks")
        cuts = cut.join(counts, "list").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("list", "block", "centroids")
        return rows.groupBy("list", "block").cogroup(cuts.groupBy("list", "block")).applyInPandas(lambda a, b: placed(a, b, within, most, v), schema)

    return (
        stored(dealt(posted, "key", "v", NEAR, COPIES_BELOW, f"list long, key binary, v {kind}, least long"), "lists"),
        stored(dealt(asking, "qkey", "q", ratio, None, f"list long, qkey binary, q {kind}"), "asking"),
    )


def search(vectors: DataFrame, is_query, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", ratio: float = RATIO, sample: int = SAMPLE, lists: int | None = None) -> DataFrame:
    """Rows (query_id, rank, vec_id, score): the k nearest other rows of each row for which is_query(id) holds."""
    spark = vectors.sparkSession
    ship(spark)
    v = F.col("v")
    given = vectors.schema[vector_col].dataType.simpleString()
    kind = given if given in ("array<float>", "array<double>") else "array<double>"
    ok = F.col("id").isNotNull() & v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast(kind).alias("v")).where(ok)
    sizes = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").limit(1)
    rows = rows.join(F.broadcast(sizes.select("n")), F.size("v") == F.col("n"), "left_semi").withColumn("query", is_query(F.col("id")))
    # One row for each distinct vector: its key, the k + 1 smallest ids. Ranks are limited before the shuffle too.
    key = F.sha2(F.array_join(F.col("v").cast("array<string>"), ","), 256)
    rows = rows.withColumn("key", F.unhex(key))
    first = Window.partitionBy("key").orderBy("id")
    few = rows.dropDuplicates(["key", "id"]).withColumn("nth", F.row_number().over(first)).where(F.col("nth") <= k + 1)
    distinct = stored(few.groupBy("key").agg(F.array_sort(F.collect_list("id")).alias("ids"), F.first("v").alias("v")), "vectors")
    asked = stored(rows.where("query").select("key", "id").distinct(), "queries")
    n = distinct.count()
    graph = fit(distinct, n, sample, lists)
    empty = "query_id long, rank int, vec_id long, score double"
    if graph is None:
        return spark.range(0).select(*[F.lit(None).cast(t).alias(c) for c, t in (p.split() for p in empty.split(", "))])
    shared = spark.sparkContext.broadcast((graph.centroids, graph.links))

    posted = _assigned(distinct, shared, NEAR, COPIES, "binary", kind).join(distinct.select("key", F.col("ids")[0].alias("least")), "key")
    posted = stored(posted.select(F.col("list").cast("long").alias("list"), "key", "v", "least"), "lists")
    asking = _assigned(distinct.join(asked.select("key").distinct(), "key", "left_semi"), shared, ratio, None, "binary", kind)
    asking = stored(asking.select(F.col("list").cast("long").alias("list"), F.col("key").alias("qkey"), F.col("v").alias("q")), "asking")
    many = len(graph.centroids)
    while not lists and n > 2 * LIST_SIZE * many:
        posted, asking = _deeper(posted, asking, ratio, kind)
        many *= SPLITS
    span = F.floor(F.col("list") / SPAN)
    posted, asking = posted.withColumn("span", span), asking.withColumn("span", span)
    # Long spans are cut into blocks, and the queries of a span into groups.
    part = lambda df, name: df.groupBy("span").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias(name))
    blocks, groups = part(posted, "blocks"), part(asking, "groups")
    lay = lambda of, n: F.pmod(F.xxhash64(of), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = posted.join(blocks, "span").join(groups, "span").withColumn("block", lay("key", "blocks")).withColumn("group", every("groups"))
    right = asking.join(blocks, "span").join(groups, "span").withColumn("group", lay("qkey", "groups")).withColumn("block", every("blocks"))
    keys = ["span", "block", "group"]
    made = left.select(*keys, "list", "key", "v", "least").groupBy(*keys).cogroup(right.select(*keys, "list", "qkey", "q").groupBy(*keys))
    found = made.applyInPandas(lambda a, b: _best(a, b, k), "qkey binary, key binary, score double").distinct()
    found = found.join(distinct.select("key", "ids"), "key").select("qkey", F.explode("ids").alias("vec_id"), "score")
    near = Window.partitionBy("qkey").orderBy("score", "vec_id")
    found = found.withColumn("nth", F.row_number().over(near)).where(F.col("nth") <= k + 1).groupBy("qkey").agg(F.array_sort(F.collect_list(F.struct("score", "vec_id"))).alias("found"))
    pairs = asked.join(found, asked["key"] == found["qkey"]).select(F.col("id").alias("query_id"), F.slice(F.filter("found", lambda x: x["vec_id"] != F.col("id")), 1, k).alias("found"))
    out = pairs.select("query_id", F.posexplode("found").alias("at", "x"))
    return out.select("query_id", (F.col("at") + 1).alias("rank"), F.col("x.vec_id").alias("vec_id"), F.col("x.score").alias("score"))


def op3_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "embeddings"), lambda i: i % 100 == 0)


SQL: dict[str, str] = {}
QUERIES = {"op3_neighbours": op3_neighbours}
