"""Connected components by alternating large-star and small-star steps (DataFrame operations only)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import by_shuffle, stored


def _state(edges: DataFrame) -> tuple:
    """Count and two order-free checksums of the edges; three numbers reach the driver."""
    h = F.xxhash64("a", "b")
    return tuple(edges.agg(F.count("*"), F.sum(h.cast("decimal(20,0)")), F.expr("bit_xor(xxhash64(b, a, 7))")).first())


def _large_star(edges: DataFrame) -> DataFrame:
    """Each node links its larger neighbours to the least node of its neighbourhood. May repeat edges."""
    both = edges.select("a", "b").unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m"))
    joined = both.join(by_shuffle(least.withColumnRenamed("a", "k")), F.col("a") == F.col("k"))
    return joined.where("b > a").select(F.col("b").alias("a"), F.least("m", "a").alias("b")).where("a <> b")


def _small_star(edges: DataFrame) -> DataFrame:
    """Each node links itself and its smaller neighbours to the least of them. Needs a > b."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    joined = edges.join(by_shuffle(least.withColumnRenamed("a", "k")), F.col("a") == F.col("k"))
    links = F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct(F.col("a"), F.col("m").alias("b"))))
    return joined.select(links.alias("e")).select("e.a", "e.b").where("a <> b").distinct()


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Rows (node, component) for every node of an edge; component is the least node reachable.

    Takes undirected edges between nodes of any orderable type; rows with a null end and loops are left
    out, repeated edges count once. The edges turn into stars in O(log n) rounds; each round is stored, so
    lineage stays short. A hub's edges are spread over tasks by Spark's skew-join handling: the other side of
    each join has one row a node, and the minima are combined before the shuffle.
    """
    now = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a <> b")
    now = stored(now.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    before, state = None, _state(now)
    while state != before and state[0]:
        now = stored(_small_star(_large_star(now)), "edges")
        before, state = state, _state(now)
    nodes = now.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return nodes.unionAll(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
