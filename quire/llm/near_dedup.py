"""Near-duplicate documents by MinHash signatures and a multi-index Hamming join.

A document's shingles give a signature of POSITIONS symbols of BITS bits; two documents' symbols agree at a position with
the probability of their Jaccard similarity. Signatures are cut into CHUNKS chunks. If two signatures differ at no more than
DISTANCE positions, some chunk differs at no more than DISTANCE // CHUNKS = 1 position (pigeonhole), so both have the same
key when each chunk is written once for each position left out: these keys enumerate the allowed chunk errors, and an
equal join of keys meets every pair within DISTANCE. Pairs farther apart that share a key are looked at as well, up to FAR,
so a pair of similarity 0.8 escapes with a probability of about 0.0002, and one of 0.85 with 0.00001. Every link is confirmed on the full shingle sets.

Documents with equal sets are one node from the start. A key's documents don't meet pairwise: each is compared with the
key's pivot, the document whose keys are shared most, and links so found make components. Only keys whose documents are then
not in one component are looked at further. Keys that share documents form a cell, so each document of those keys is read
once, with its full set. Of a cell, documents that no other can be linked with leave first: those of whose shingles too many
stand in no other document of the cell. The cell's largest component needs no comparison in itself; every other document is
compared with all of the cell, exactly, on full sets. Cells are cut into blocks of bounded size, and a task takes two of them,
so a cell may be of any size; only links that join components leave the task. So no link between components is lost, there is
no cap, and a group of n near copies costs n comparisons and those of its stragglers. Documents of which each could be linked
with the others by its size and its shared shingles, but isn't, are compared pairwise, in blocks.

Words are maximal runs of other characters than ``[\\x20\\x09-\\x0D]``, with A-Z lower-cased. A document with fewer words
than a shingle has one shingle, all its words. A null, empty or blank text has none and is linked with nothing. A null id
is linked with nothing, has a null component, and is kept. Rows that repeat an id are told apart by their texts; rows equal in
both are one document. An empty table gives an empty result. Very long texts are worked on whole; further columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.llm.common import by_shuffle, ship, stored, table
from quire.llm.components import components

POSITIONS, CHUNKS, BITS = 48, 8, 16
WIDTH = POSITIONS // CHUNKS
#: Signature distance up to which pairs are certain to share a key, and up to which pairs that do are compared.
DISTANCE, FAR = 2 * CHUNKS - 1, 21
#: Shingles of a block of documents, on average; a task holds two blocks.
BLOCK = 65_536
#: Maps of 32,768 bits that tell which texts may be wanted: 4 MB at any size of the tables.
MAPS, BITS_OF_MAP = 1024, 32_768
#: Rows of two numbers that are few enough to be broadcast, so that whole texts stay where they are.
FEW = 65_536
#: Words that a worker remembers with their hashes before it starts anew.
CACHE = 300_000

LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
MULTIPLY = np.random.default_rng(11).integers(1, 2**63, POSITIONS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
ADD = np.random.default_rng(12).integers(0, 2**63, POSITIONS, dtype=np.uint64)
GOLDEN, MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)
#: The positions of each key: a chunk without one of its positions.
KEYS = [[c * WIDTH + p for p in range(WIDTH) if p != left_out] for c in range(CHUNKS) for left_out in range(WIDTH)]

_hashes: dict[bytes, int] = {}


def _hash(word: bytes) -> int:
    if len(_hashes) >= CACHE:
        _hashes.clear()
    found = xxhash.xxh3_64_intdigest(word)
    if len(word) < 64:
        _hashes[word] = found
    return found


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * MIX
    return x ^ (x >> np.uint64(31))


def shingles(text: str | None, size: int) -> np.ndarray:
    """The distinct 64-bit hashes of a whole text's shingles of size words, sorted."""
    words = (text or "").encode("utf-8", "replace").translate(LOWER).split()
    if not words:
        return np.zeros(0, np.uint64)
    get = _hashes.get
    w = np.fromiter((get(x) or _hash(x) for x in words), np.uint64, len(words))
    n = min(size, len(words))
    total = np.full(len(w) - n + 1, n, np.uint64)
    for j in range(n):
        total = _mixed(total * GOLDEN + w[j : len(w) - n + 1 + j])
    return np.unique(total)


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """A row of POSITIONS symbols for each non-empty set."""
    flat = np.concatenate(sets)
    starts = np.cumsum([0, *map(len, sets)])[:-1]
    out = np.empty((len(sets), POSITIONS), np.uint64)
    for j in range(POSITIONS):
        out[:, j] = np.minimum.reduceat(flat * MULTIPLY[j] + ADD[j], starts)
    return (_mixed(out) >> np.uint64(64 - BITS)).astype(np.int32)


def keys_of(symbols: np.ndarray) -> np.ndarray:
    """A row of keys for each signature."""
    s = symbols.astype(np.uint64)
    out = np.empty((len(s), len(KEYS)), np.uint64)
    for k, positions in enumerate(KEYS):
        packed = np.zeros(len(s), np.uint64)
        for p in positions:
            packed = (packed << np.uint64(BITS)) | s[:, p]
        out[:, k] = _mixed(_mixed(packed + GOLDEN) + np.uint64(k * int(GOLDEN) % 2**64))
    return out.view(np.int64)


def _slices(batches: Iterator[pa.RecordBatch], rows: int = 200) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, len(batch), rows):
            yield batch.slice(at, rows)


def _lists(flat: np.ndarray, sizes: list[int], kind) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *sizes], dtype=np.int32)), pa.array(flat, kind))


def signed(texts: DataFrame, size: int) -> DataFrame:
    """Rows (id, t, n, same, symbols) of rows (id, t, text): the set's size, a digest that equal sets share, and the signature; null if empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _slices(batches):
            sets = [shingles(t, size) for t in part.column(2).to_pylist()]
            full = [s for s in sets if len(s)]
            symbols = signatures(full) if full else np.zeros((0, POSITIONS), np.int32)
            same = pa.array([xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets], pa.binary())
            listed = _lists(symbols.ravel(), [POSITIONS if len(s) else 0 for s in sets], pa.int32())
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([len(s) for s in sets], pa.int64()), same, listed], names=["id", "t", "n", "same", "symbols"])

    return texts.select("id", "t", "text").mapInArrow(run, "id long, t long, n long, same binary, symbols array<int>")


def perhaps_wanted(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """The rows of texts (id, t, text) whose (id, t) may be in wanted: all that are, and few others while wanted has well below 33 million rows.

    Each wanted (id, t) sets a bit in one of MAPS maps, which have the same size for any table. So texts that no one asks for are left where
    they are read and aren't shuffled; the join that follows decides.
    """
    place = F.pmod(F.xxhash64("id", "t"), F.lit(MAPS * BITS_OF_MAP))
    maps = wanted.select(place.alias("place")).distinct().select(F.floor(F.col("place") / BITS_OF_MAP).alias("map"), (F.col("place") % BITS_OF_MAP).alias("bit"))
    maps = stored(maps.repartition("map").groupBy("map").agg(F.bitmap_construct_agg("bit").alias("bits")), "maps")
    byte = F.conv(F.hex(F.substring("bits", (F.col("bit") / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    is_set = byte.bitwiseAND(F.expr("shiftleft(1, cast(bit % 8 as int))")) != 0
    asked = texts.withColumn("place", place).withColumn("bit", F.col("place") % BITS_OF_MAP).withColumn("map", F.floor(F.col("place") / BITS_OF_MAP))
    return asked.join(F.broadcast(maps), "map").where(is_set).select("id", "t", "text")


def full_sets(nodes: DataFrame, texts: DataFrame, size: int) -> DataFrame:
    """Rows (node, set) of the nodes (node, id, t), a node's set made of its text once."""
    nodes = nodes.select("node", "id", "t")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _slices(batches):
            sets = [shingles(t, size).view(np.int64) for t in part.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(0), _lists(np.concatenate(sets), [len(s) for s in sets], pa.int64())], names=["node", "set"])

    found = perhaps_wanted(texts, nodes).join(by_shuffle(nodes), ["id", "t"]).dropDuplicates(["id", "t", "node"])
    return stored(found.select("node", "text").mapInArrow(run, "node long, set array<bigint>"), "sets")


def _keyed(nodes: DataFrame) -> DataFrame:
    """Rows (key, node) of rows (node, symbols)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, POSITIONS)
            for at in range(0, len(s), 5000):
                k = keys_of(s[at : at + 5000])
                ids = batch.column(0).slice(at, len(k)).to_numpy(zero_copy_only=False)
                yield pa.RecordBatch.from_arrays([pa.array(k.ravel()), pa.array(np.repeat(ids, len(KEYS)))], names=["key", "node"])

    return nodes.select("node", "symbols").mapInArrow(run, "key long, node long")


def _differ(a: str, b: str) -> Column:
    """The number of positions at which two signatures differ."""
    return F.size(F.filter(F.zip_with(a, b, lambda x, y: x != y), lambda x: x))


def _like(a: str, b: str, percent: int) -> Column:
    """Whether sets of these sizes can reach the similarity at all."""
    return F.least(a, b) * 100 >= F.greatest(a, b) * percent


def confirmed(close: DataFrame, nodes: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """Of pairs (a, b, na, nb), those whose full sets have 100 * intersection >= percent * union."""
    wanted = close.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    sets = full_sets(stored(nodes.join(by_shuffle(wanted), "node", "left_semi").select("node", "id", "t"), "wanted"), texts, size)
    of = lambda x: by_shuffle(sets.select(F.col("node").alias(x), F.col("set").alias(f"set{x}")))
    both = close.join(of("a"), "a").join(of("b"), "b")
    common = F.size(F.array_intersect("seta", "setb"))
    return both.where(100 * common >= percent * (F.col("na") + F.col("nb") - common)).select("a", "b")


def _links_of_blocks(part: pd.DataFrame, percent: int) -> pd.DataFrame:
    """The links between documents of side 0 and those of side 1, or among those of side 2, that join components."""
    node, component, side = (part[c].to_numpy() for c in ("node", "component", "side"))
    sets = [np.asarray(s) for s in part["set"]]
    size = np.array([len(s) for s in sets], np.int64)
    ends = np.cumsum(size)
    code = np.unique(np.concatenate(sets), return_inverse=True)[1]
    columns = np.flatnonzero(side != 0)
    # The columns that have each shingle: a list for each code, one after the other.
    holder = np.repeat(np.arange(len(columns)), size[columns])
    codes = np.concatenate([code[ends[c] - size[c] : ends[c]] for c in columns]) if len(columns) else np.zeros(0, np.int64)
    holder = holder[np.argsort(codes, kind="stable")]
    stops = np.cumsum(np.bincount(codes, minlength=int(code.max()) + 1))
    starts = np.concatenate([[0], stops[:-1]])
    above = {c: c for c in component.tolist()}

    def root(c: int) -> int:
        while above[c] != c:
            above[c] = c = above[above[c]]
        return c

    found = []
    for r in np.flatnonzero(side != 1):
        mine = code[ends[r] - size[r] : ends[r]]
        common = np.bincount(np.concatenate([holder[a:b] for a, b in zip(starts[mine], stops[mine], strict=True)]), minlength=len(columns))
        for k in np.flatnonzero(100 * common >= percent * (size[r] + size[columns] - common)):
            x, y = root(int(component[r])), root(int(component[columns[k]]))
            if x != y:
                above[x] = y
                found.append((node[r], node[columns[k]]))
    return pd.DataFrame(found, columns=["a", "b"], dtype="int64")


def cell_links(left: DataFrame, nodes: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """Links that join components, of rows (cell, node, component): every two rows of a cell are compared, but for those of its largest component."""
    left = stored(left.join(by_shuffle(nodes.select("node", "id", "t", "n")), "node"), "cells")
    sets = full_sets(left, texts, size)
    # Shingles that no other document of the cell has are in no intersection: with too many of them nothing can be linked.
    alone = left.join(by_shuffle(sets), "node").select("cell", "node", F.explode("set").alias("shingle")).groupBy("cell", "shingle").agg(F.count("*").alias("many"), F.min("node").alias("node"))
    alone = alone.where("many = 1").groupBy("node").agg(F.count("*").alias("alone"))
    left = left.join(by_shuffle(alone), "node", "left").where(100 * (F.col("n") - F.coalesce("alone", F.lit(0))) >= percent * F.col("n"))
    left = stored(left.select("cell", "node", "component", "n"), "cells")
    parts = left.groupBy("cell", "component").agg(F.sum("n").alias("size"))
    cells = parts.groupBy("cell").agg(F.max(F.struct("size", "component")).alias("main"), F.sum("size").alias("all"), F.count("*").alias("parts")).where("parts > 1")
    count = lambda n: F.ceil(n / BLOCK).cast("int")
    cells = stored(cells.select("cell", F.col("main.component").alias("main"), count(F.col("main.size")).alias("mains"), count(F.col("all") - F.col("main.size")).alias("others")), "cells")
    placed = left.join(by_shuffle(cells), "cell").withColumn("inner", F.col("component") == F.col("main"))
    placed = placed.withColumn("block", F.pmod(F.xxhash64("node"), F.when(F.col("inner"), F.col("mains")).otherwise(F.col("others"))).cast("int"))
    # Blocks of others are numbered first. Task (i, j), i <= j: block i of the others with block j of all.
    block, others = F.col("block"), F.col("others")
    task = lambda i, j, side: F.struct(i.alias("i"), j.alias("j"), F.lit(side).alias("side"))
    upto = lambda n: F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    as_other = F.concat(F.array(task(block, block, 2)), F.transform(upto(others + F.col("mains") - block - 1), lambda k: task(block, block + k + 1, 0)), F.transform(upto(block), lambda i: task(i, block, 1)))
    tasks = F.when(F.col("inner"), F.transform(upto(others), lambda i: task(i, others + block, 1))).otherwise(as_other)
    dealt = placed.select("cell", "node", "component", tasks.alias("tasks")).join(by_shuffle(sets), "node").select("cell", "node", "component", "set", F.explode("tasks").alias("task"))
    dealt = dealt.select("cell", "task.i", "task.j", "task.side", "node", "component", "set")
    return dealt.groupBy("cell", "i", "j").applyInPandas(lambda part: _links_of_blocks(part, percent), "a long, b long")


def near_groups(docs: DataFrame, size: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, n_shingles, component_id (the least id reachable by links), kept (it is the own id)."""
    out = _grouped(docs, size, percent, id_col, text_col)
    return out.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), "component_id", F.col("stays").alias("kept"))


def _grouped(docs: DataFrame, size: int, percent: int, id_col: str, text_col: str) -> DataFrame:
    """Rows (id, t, n, component_id, stays) for the rows of docs; t is a hash of the text."""
    ship(docs.sparkSession)
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(F.col(text_col)).alias("t"), F.col(text_col).alias("text"))
    rows = stored(signed(texts, size), "signatures")
    least = Window.partitionBy("same").orderBy("id", "t")
    nodes = rows.where("id is not null and same is not null").withColumn("nth", F.row_number().over(least)).where("nth = 1")
    nodes = stored(nodes.select(F.monotonically_increasing_id().alias("node"), "same", "id", "t", "n", "symbols"), "nodes")

    members = _keyed(nodes)
    shared = stored(members.join(by_shuffle(members.groupBy("key").agg(F.count("*").alias("many")).where("many > 1")), "key"), "buckets")
    # A key's pivot is the document that stands in the most and longest keys: near copies gather around it.
    weight = shared.groupBy("node").agg(F.sum("many").alias("weight"))
    pivots = shared.join(by_shuffle(weight), "node").groupBy("key").agg(F.max(F.struct("weight", (-F.col("node")).alias("less"))).alias("best"))
    spokes = stored(shared.join(by_shuffle(pivots.select("key", (-F.col("best.less")).alias("pivot"))), "key").where("node <> pivot"), "spokes")
    side = lambda x: by_shuffle(nodes.select(F.col("node").alias(x), F.col("symbols").alias(f"s{x}"), F.col("n").alias(f"n{x}")))
    pairs = spokes.select(F.least("pivot", "node").alias("a"), F.greatest("pivot", "node").alias("b")).distinct().join(side("a"), "a").join(side("b"), "b")
    close = stored(pairs.where(_like("na", "nb", percent)).where(_differ("sa", "sb") <= FAR).select("a", "b", "na", "nb"), "pairs")
    links = stored(confirmed(close, nodes, texts, size, percent), "links")
    group = stored(components(links), "components")

    at = shared.where("many > 2").join(by_shuffle(group), "node", "left").select("key", "node", F.coalesce("component", "node").alias("component"))
    open_ = at.groupBy("key").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x <> y").select("key")
    cells = stored(components(spokes.join(by_shuffle(open_), "key", "left_semi").select(F.col("node").alias("a"), F.col("pivot").alias("b"))), "cells")
    if not cells.isEmpty():
        left = cells.withColumnRenamed("component", "cell").join(by_shuffle(group), "node", "left").select("cell", "node", F.coalesce("component", "node").alias("component"))
        more = stored(cell_links(left, nodes, texts, size, percent), "links")
        if not more.isEmpty():
            group = stored(components(group.select(F.col("node").alias("a"), F.col("component").alias("b")).unionAll(more)), "components")

    # A component is named by its least document, whatever the numbers of its nodes.
    known = nodes.select("node", "same", "id").join(by_shuffle(group), "node", "left").withColumn("component", F.coalesce("component", "node"))
    names = known.groupBy("component").agg(F.min(F.struct("id", "same")).alias("best"))
    named = known.join(by_shuffle(names), "component").select(F.col("same").alias("__same"), F.col("best.id").alias("__name"), (F.col("best.same") == F.col("same")).alias("__first"))
    out = rows.join(by_shuffle(named), rows["same"] == named["__same"], "left").withColumn("component_id", F.when(F.col("id").isNotNull(), F.coalesce("__name", "id")))
    first = F.coalesce(F.col("__first") | F.col("__name").isNull(), F.lit(True))
    return out.select("id", "t", "n", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("stays"), first.alias("first"))


def drop_near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with all its columns, one document of each group. Of texts with the same id and near to each other one stays, too."""
    lost = _grouped(docs, size, percent, id_col, text_col).where("not stays or not first").select(F.col("id").alias("__lost"), F.col("t").alias("__t")).where("__lost is not null").distinct()
    lost = stored(lost, "lost")
    lost = F.broadcast(lost) if lost.count() <= FEW else by_shuffle(lost)
    return docs.join(lost, (docs[id_col].cast("long") == lost["__lost"]) & (F.xxhash64(docs[text_col]) == lost["__t"]), "left_anti")


def op9_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_groups(table(spark, sf_dir, "documents"), size=2)


SQL: dict[str, str] = {
    "op9_near_dedup": r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) = 1 THEN w ELSE list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) END AS s FROM w),
c AS (SELECT s AS set_, min(doc_id) AS id, len(any_value(s)) AS n FROM (SELECT doc_id, list_sort(s) AS s FROM s WHERE len(s) > 0) GROUP BY 1),
e AS (SELECT id, n, unnest(set_) AS g FROM c),
links AS (SELECT a.id AS a, b.id AS b FROM e a JOIN e b ON a.g = b.g AND a.id < b.id AND least(a.n, b.n) * 100 >= 80 * greatest(a.n, b.n)
          GROUP BY a.id, b.id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
both_ AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach(u, v) AS (SELECT a, b FROM both_ UNION SELECT r.u, x.b FROM reach r JOIN both_ x ON r.v = x.a),
comp AS (SELECT c.set_, least(c.id, coalesce(min(r.v), c.id)) AS component FROM c LEFT JOIN reach r ON r.u = c.id GROUP BY c.set_, c.id)
SELECT s.doc_id, len(s.s)::BIGINT AS n_shingles, coalesce(comp.component, s.doc_id) AS component_id, s.doc_id = coalesce(comp.component, s.doc_id) AS kept
FROM s LEFT JOIN comp ON list_sort(s.s) = comp.set_""",
}
QUERIES = {"op9_near_dedup": op9_near_dedup}
