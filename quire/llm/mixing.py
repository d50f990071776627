"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree (DataFrame operations only).

Every source is cut into blocks of documents, ranges of a hash of the document, so the order of blocks and of the
documents in them is a random permutation. A source's target in words is a number of block copies: whole passes over its
blocks, a number of further blocks, and a last one of which only some documents are taken. These block quotas, one for
each source, stand at the root of a binary tree with the output shards as leaves. Each node shares its blocks
between its children by drawing without replacement (a multivariate-hypergeometric draw: source by source, block by
block, with a hash as the coin), so quotas are kept exactly. A shard draws the next run of each source's permuted
blocks that the tree leaves it, disjoint from all other shards' runs; a document's copies are those that its block has in
the shards' runs, and each shard orders its documents by another hash.

The tree sees only quotas: a row for each node and group of GROUP sources. With more sources the groups are split first, by the same
tree, and then each group's sources with the group's quotas as given, to any number of sources. Documents are read where they are, joined only with the table of sources and with the chosen documents of the last
blocks, and shuffled once, into their shards. The last block of a large source is cut once more, into parts by further bits
of the hash, so that single documents are chosen from some hundreds of them at any size of the source.

A null text counts 0 words, a null source is a source (the last one), a null id is an id like others. Rows equal in
id and text are taken together. Very long texts are documents like others: whole, or not taken. An empty table gives an empty
mix. Sources without words have the target 0. mixed carries all columns whatever their names; op4_mixing reads three.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.llm.common import WORD, stored, table

#: Documents that a block holds on average, as long as a source has at most BLOCKS blocks; else those of a part of its last block.
BLOCK_DOCS = 256
BLOCKS = 4096
#: Sources that one row of the tree holds.
GROUP = 256
#: No source is taken more often than this.
MOST = 3
#: Weights by the sources' order, repeating.
WEIGHTS = (1, 2, 3)
SHARDS = 16
#: Windows over the last block, each of which fills what the one before has left.
FILLS = 4


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _keyed(docs: DataFrame, id_col: str, text_col: str, source_col: str, seed: int) -> DataFrame:
    """docs with __size, __source and __hash (60 random bits that only id and text decide)."""
    h = F.pmod(F.xxhash64(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")), F.lit(seed)), F.lit(2**60))
    return docs.withColumns({"__size": words(F.col(text_col)), "__source": F.col(source_col), "__id": F.col(id_col), "__hash": h})


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """Rows (source, n, source_size, no, weight, target) of rows (source, n, source_size); one row a source.

    Water filling in closed form: sources sorted by most * size / weight meet their limit in that order; the first
    whose limit lies above the level of those left, and all after it, share what is left by weight.
    """
    no = F.row_number().over(Window.orderBy(F.asc_nulls_last("source")))
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), F.pmod(F.col("no") - 1, F.lit(len(weights))).cast("int") + 1)
    s = sizes.withColumn("no", no).withColumn("weight", weight).withColumn("limit", most * F.col("source_size"))
    order = Window.orderBy(F.col("limit") / F.col("weight"), "no")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    s = s.withColumn("left", F.sum("source_size").over(every) - F.coalesce(F.sum("limit").over(before), F.lit(0)))
    s = s.withColumn("left_weight", F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
    open_ = F.col("limit") * F.col("left_weight") >= F.col("left") * F.col("weight")
    s = s.withColumn("first", F.min(F.when(open_, F.struct(F.row_number().over(order).alias("i"), "left", "left_weight"))).over(every))
    fair = F.col("weight") * F.col("first.left") / F.col("first.left_weight")
    return s.select("source", "n", "source_size", "no", "weight", F.least(F.coalesce(fair, F.lit(0.0)), F.col("limit").cast("double")).alias("target"))


def _coin(*parts) -> Column:
    return F.pmod(F.xxhash64(*parts), F.lit(2**30)) / F.lit(float(2**30))


def _left_quotas(quotas: Column, room: Column, key: Column, node: Column, seed: int) -> Column:
    """What the left child gets of each source's quota: room of the node's blocks, drawn without replacement."""
    total = F.aggregate(quotas, F.lit(0).cast("long"), lambda acc, q: acc + q)
    start = F.struct(total.alias("all"), room.cast("long").alias("room"), F.array().cast("array<bigint>").alias("got"), F.lit(0).alias("no"))

    def source(acc: Column, quota: Column) -> Column:
        urn = F.struct(acc["all"].alias("all"), acc["room"].alias("room"))

        def block(u: Column, i: Column) -> Column:
            hit = _coin(F.lit(seed), key, node, acc["no"], i) * u["all"] < u["room"]
            return F.struct((u["all"] - 1).alias("all"), (u["room"] - hit.cast("long")).alias("room"))

        drawn = F.aggregate(F.when(quota > 0, F.sequence(F.lit(1).cast("long"), quota)).otherwise(F.array().cast("array<bigint>")), urn, block)
        one = F.array(drawn)  # so that the draw is done once for the two fields that need it
        return F.element_at(F.transform(one, lambda d: F.struct(d["all"].alias("all"), d["room"].alias("room"), F.concat(acc["got"], F.array(acc["room"] - d["room"])).alias("got"), (acc["no"] + 1).alias("no"))), 1)

    return F.aggregate(quotas, start, source)["got"]


def _sum(numbers: Column) -> Column:
    return F.aggregate(numbers, F.lit(0).cast("long"), lambda acc, q: acc + q)


def _even(total: Column, depth: int) -> Column:
    """What the leaves of a tree hold if each node gives half, rounded down, to its left child."""
    rooms = F.array(total.cast("long"))
    for _ in range(depth):
        rooms = F.flatten(F.transform(rooms, lambda r: F.array(F.floor(r / 2).cast("long"), (r - F.floor(r / 2)).cast("long"))))
    return rooms


def split_quotas(sources: DataFrame, shards: int = SHARDS, seed: int = 0) -> DataFrame:
    """Rows (no, ends) of rows (no, quota): ends has, for each shard, where its run of the source's block copies ends.

    Many sources are split in two steps: first groups of GROUP sources, by the same tree, then each group's sources among the
    shards, with what the group has in each shard as given. Both steps together are one draw without replacement.
    """
    depth = int(math.log2(shards))
    if 2**depth != shards:
        raise ValueError("shards must be a power of two")
    grouped = sources.groupBy(F.floor(F.col("no") / GROUP).alias("group")).agg(F.array_sort(F.collect_list(F.struct("no", "quota"))).alias("x"))
    grouped = grouped.select("group", F.transform("x", lambda x: x["no"]).alias("nos"), F.transform("x", lambda x: x["quota"].cast("long")).alias("quotas"))
    totals = grouped.select(F.col("group").alias("no"), _sum(F.col("quotas")).alias("quota"))
    if totals.limit(2).count() < 2:
        nodes = grouped.withColumn("rooms", _even(_sum(F.col("quotas")), depth))
    else:
        outer = split_quotas(totals, shards, seed + 1).select(F.col("no").alias("group"), F.transform("ends", lambda e, i: e - F.when(i > 0, F.get("ends", i - 1)).otherwise(0)).alias("rooms"))
        nodes = stored(grouped.join(outer, "group"), "groups")
    nodes = nodes.withColumn("node", F.lit(1).cast("long"))
    for level in range(depth):
        half = 2 ** (depth - level - 1)
        first, rest = F.slice("rooms", 1, half), F.slice("rooms", half + 1, half)
        nodes = nodes.withColumn("left", _left_quotas(F.col("quotas"), _sum(first), F.col("group"), F.col("node"), seed))
        right = F.zip_with("quotas", "left", lambda q, l: q - l)
        children = F.array(F.struct((F.col("node") * 2).alias("node"), F.col("left").alias("quotas"), first.alias("rooms")), F.struct((F.col("node") * 2 + 1).alias("node"), right.alias("quotas"), rest.alias("rooms")))
        nodes = nodes.select("group", "nos", F.explode(children).alias("c")).select("group", "nos", "c.node", "c.quotas", "c.rooms")
    leaves = nodes.select("node", F.explode(F.arrays_zip("nos", "quotas")).alias("x")).select("node", F.col("x.nos").alias("no"), F.col("x.quotas").alias("quota"))
    upto = Window.partitionBy("no").orderBy("node").rowsBetween(Window.unboundedPreceding, 0)
    ends = leaves.withColumn("end", F.sum("quota").over(upto)).groupBy("no").agg(F.array_sort(F.collect_list(F.struct("node", "end"))).alias("e"))
    return ends.select("no", F.transform("e", lambda x: x["end"]).alias("ends"))


def _block(h: str, blocks: str) -> Column:
    """The block of a document, by the first 30 bits of its hash."""
    return F.expr(f"({h} div 1073741824) * {blocks} div 1073741824")


def _part(h: str, parts: str) -> Column:
    """The part of its block that a document is in, by the last 30 bits of its hash."""
    return F.expr(f"({h} % 1073741824) * {parts} div 1073741824")


def _reached(pieces: DataFrame, piece: str, room: str) -> DataFrame:
    """Of rows (no, piece, words) with a room for each no: the piece in which the room ends, and what is left of the room there.

    All pieces before it are taken whole. Pieces may be missing; without words after the room's end there is no row.
    """
    before = Window.partitionBy("no").orderBy(piece).rowsBetween(Window.unboundedPreceding, -1)
    start = pieces.withColumn("start", F.coalesce(F.sum("words").over(before), F.lit(0)))
    return start.where(f"start <= {room} and start + words > {room}").select("no", F.col(piece).alias(f"last_{piece}"), (F.col(room) - F.col("start")).alias(f"{piece}_room"))


def _plan(sized: DataFrame, shards: int, seed: int) -> tuple[DataFrame, DataFrame]:
    """The table of sources, and of the documents that the last parts of their last blocks give (source, id, hash)."""
    sizes = sized.groupBy(F.col("__source").alias("source")).agg(F.count("*").alias("n"), F.sum("__size").alias("source_size"))
    sizes = stored(sizes, "sources")
    up = lambda x, most: F.greatest(F.lit(1), F.least(F.lit(most), F.ceil(x))).cast("long")
    plan = targets(sizes).withColumn("blocks", up(F.col("n") / BLOCK_DOCS, BLOCKS))
    plan = plan.withColumn("parts", up(F.col("n") / F.col("blocks") / BLOCK_DOCS, BLOCKS))
    passes = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    plan = stored(plan.withColumn("passes", passes.cast("long")).withColumn("rest", F.col("target") - F.col("passes") * F.col("source_size")), "targets")
    placed = sized.join(plan, sized["__source"].eqNullSafe(plan["source"])).withColumn("block", _block("__hash", "blocks"))
    last = _reached(placed.groupBy("no", "rest", "block").agg(F.sum("__size").alias("words")), "block", "rest")
    plan = plan.join(last, "no", "left").withColumns({"last": F.coalesce("last_block", F.lit(0)), "room": F.coalesce("block_room", F.lit(0.0))}).drop("last_block", "block_room")
    plan = plan.withColumn("quota", F.col("passes") * F.col("blocks") + F.col("last") + (F.col("room") > 0).cast("long"))
    plan = stored(plan.join(split_quotas(plan, shards, seed), "no"), "quotas")

    few = sized.join(plan, sized["__source"].eqNullSafe(plan["source"])).where((F.col("room") > 0) & (_block("__hash", "blocks") == F.col("last"))).withColumn("part", _part("__hash", "parts"))
    few = stored(few.groupBy("no", "__id", "__hash", "room", "part").agg(F.sum("__size").alias("words")), "last-blocks")
    ends = _reached(few.groupBy("no", "room", "part").agg(F.sum("words").alias("words")), "part", "room")
    plan = stored(plan.join(ends, "no", "left").withColumns({"last_part": F.coalesce("last_part", F.lit(0)), "part_room": F.coalesce("part_room", F.lit(0.0))}), "parts")

    few = few.join(ends, "no").where("part = last_part").withColumn("taken", F.lit(False))
    by = Window.partitionBy("no")
    for i in range(FILLS):
        few = few.withColumn("open", F.col("part_room") - F.sum(F.when(F.col("taken"), F.col("words")).otherwise(0)).over(by))
        fits = ~F.col("taken") & (F.col("words") <= F.col("open"))
        order = by.orderBy("__hash", "__id") if i == 0 else by.orderBy(F.desc("words"), "__hash", "__id")
        few = few.withColumn("upto", F.sum(F.when(fits, F.col("words")).otherwise(0)).over(order.rowsBetween(Window.unboundedPreceding, 0)))
        few = few.withColumn("taken", F.col("taken") | (fits & (F.col("upto") <= F.col("open"))))
    # Nothing that is left fits; the document that comes nearest goes over the target if that is nearer than staying below.
    few = few.withColumn("open", F.col("part_room") - F.sum(F.when(F.col("taken"), F.col("words")).otherwise(0)).over(by))
    over = F.abs(F.col("open") - F.col("words"))
    few = few.withColumn("nth", F.row_number().over(by.orderBy("taken", over, "__hash", "__id")))
    few = few.withColumn("taken", F.col("taken") | ((F.col("nth") == 1) & (over < F.col("open"))))
    chosen = stored(few.where("taken").select(F.col("no").alias("__no"), F.col("__id").alias("__cid"), F.col("__hash").alias("__chash")), "chosen")
    return plan, chosen


def placements(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", shards: int = SHARDS, seed: int = 0, sized: DataFrame | None = None) -> DataFrame:
    """docs with __size, __source_size, __target and __copies: the mix's copies as array<struct<pass, block, shard, key>>.

    An empty array means that the mix leaves the document out. key orders a shard's documents.
    sized may hold the stored columns __id, __source, __size, __hash of the same rows, to read the texts once only.
    """
    wide = docs if sized is not None else _keyed(docs, id_col, text_col, source_col, seed)
    plan, chosen = _plan(sized if sized is not None else wide.select("__id", "__source", "__size", "__hash"), shards, seed)
    p = plan.select(*[F.col(c).alias(f"__{c}") for c in ("no", "blocks", "parts", "last_part", "room", "ends", "source_size", "target")], F.col("source").alias("__of"))
    out = wide.join(p, wide["__source"].eqNullSafe(p["__of"])).withColumn("__block", _block("__hash", "__blocks"))
    c = chosen.withColumnRenamed("__no", "__cno")
    out = out.join(c, (out["__no"] == c["__cno"]) & out["__id"].eqNullSafe(c["__cid"]) & (out["__hash"] == c["__chash"]), "left")
    # A copy is in the shard whose run of the source's block copies holds the block's place in that pass. The last place of all
    # is that of a block of which only some documents are taken, if there is room for a part of one.
    quota = F.element_at("__ends", -1)
    some = (_part("__hash", "__parts") < F.col("__last_part")) | F.col("__cno").isNotNull()

    def copy(i: Column) -> Column:
        at = i * F.col("__blocks") + F.col("__block")
        shard = F.size(F.filter("__ends", lambda e: e <= at))
        whole = (at < quota - 1) | (F.col("__room") <= 0) | some
        return F.when((at < quota) & whole, F.struct(i.cast("int").alias("pass"), F.col("__block").alias("block"), shard.alias("shard"), F.xxhash64(F.lit(seed + 1), F.col("__hash"), i).alias("key")))

    copies = F.array_compact(F.transform(F.array(*[F.lit(i).cast("long") for i in range(MOST)]), copy))
    return out.withColumn("__copies", copies).drop("__no", "__blocks", "__parts", "__last_part", "__room", "__ends", "__of", "__block", "__cno", "__cid", "__chash")


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", shards: int = SHARDS, seed: int = 0) -> DataFrame:
    """The mix: docs' columns, a row for each copy taken, dealt into shards and shuffled inside each."""
    names = docs.columns
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("__row"), F.col(id_col).alias("__i"), F.col(text_col).alias("__t"), F.col(source_col).alias("__s"))
    out = placements(rows, "__i", "__t", "__s", shards, seed).select("__row", F.explode("__copies").alias("__copy"))
    out = out.repartition(F.col("__copy.shard"), F.pmod(F.col("__copy.key"), F.lit(64))).sortWithinPartitions("__copy.shard", "__copy.key")
    return out.select(*[F.col("__row").getField(c).alias(c) for c in names])


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's columns, and each copy's pass, block, shard and key."""
    docs = _keyed(table(spark, sf_dir, "documents").select("doc_id", "text", "source"), "doc_id", "text", "source", 0)
    sized = stored(docs.select("doc_id", "__id", "__source", "__size", "__hash"), "sizes")
    out = placements(sized, sized=sized)
    return out.select("doc_id", F.col("__size").alias("size"), F.col("__source_size").alias("source_size"), F.col("__target").alias("target"), (F.col("__size") * F.size("__copies")).alias("taken"), F.col("__copies").alias("copies"))


SQL: dict[str, str] = {}
QUERIES = {"op4_mixing": op4_mixing}
