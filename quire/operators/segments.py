"""Segments from parse results of unknown shape: JSON of several layouts as one relation.

Documents are read by one Arrow-batched function each: JSON trees have any depth and shape, so what a node says (its score,
text, page, kind and box) is looked up by names in any case. Everything behind that is relational: ids, thresholds, layout
scores by overlap, counts of pages.
"""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.operators.geometry import bbox, coordinate_systems, layout_scores, to_unit
from quire.shipping import ship

# Names under which a score, a text, captions, an image, a page, a box, a kind and a page's parts are found, in
# order of preference.
SCORE_KEYS = ("score", "confidence", "conf", "probability", "avg_score")
TEXT_KEYS = ("text", "content", "table_body", "html", "latex", "markdown")
CAPTION_KEYS = ("image_caption", "table_caption", "caption", "img_caption", "footnote")
IMAGE_KEYS = ("img_path", "image_path", "img", "image")
PAGE_KEYS = ("page_idx", "page_index", "page_no", "page_number", "page")
ONE_BASED = ("page_no", "page_number")
BBOX_KEYS = ("bbox", "box", "poly", "polygon")
KIND_KEYS = ("type", "category", "label", "block_type")
PAGE_LISTS = ("pages", "page_info", "pdf_info")
COUNT_KEYS = ("pages", "page_info", "layout_dets")
#: How deep a scored node's descendants are looked at for its text.
TEXT_DEPTH = 3
BOX = "struct<x0:double,y0:double,x1:double,y1:double>"
NODE = f"struct<path:string,page_idx:int,kind:string,text:string,score:double,source:string,box:{BOX}>"


#: What a name tells of a node, and how much the name is preferred.
ROLES = {
    name: (role, rank)
    for role, names in (("score", SCORE_KEYS), ("text", TEXT_KEYS), ("caption", CAPTION_KEYS), ("image", IMAGE_KEYS), ("page", PAGE_KEYS), ("box", BBOX_KEYS), ("kind", KIND_KEYS))
    for rank, name in enumerate(names)
}
JSON_TOKEN = re.compile(r'\s*(?:([\[\]{},:])|("(?:[^"\\]|\\.)*"|[^\s\[\]{},:"]+))', re.S)


def number(value) -> float | None:
    """A number or a text that is one; the mean of a list's numbers; booleans are none."""
    if isinstance(value, list):
        known = [x for x in map(number, value) if x is not None]
        return sum(known) / len(known) if known else None
    try:
        return None if isinstance(value, (bool, dict)) or value is None else float(value)
    except ValueError:
        return None


def scale(value: float | None) -> float | None:
    """Shares as they are, percents as shares, anything else as unknown."""
    if value is None or not 0 <= value <= 100:
        return None
    return value if value <= 1 else value / 100


def read_json(value: str | None):
    """The tree of a JSON text, None for what is none. One that is nested deeper than the parser goes is read token by token."""
    try:
        return json.loads(value or "null")
    except RecursionError:
        return _deep_json(value)
    except ValueError:
        return None


def _deep_json(text: str):
    """A JSON text by its tokens, with a stack of the open objects and lists. Lenient: separators only separate."""
    top: list = []
    open_: list[tuple[object, list]] = [(top, [])]
    at = 0
    while m := JSON_TOKEN.match(text, at):
        at = m.end()
        node, names = open_[-1]
        if m[1] in ("]", "}"):
            if len(open_) == 1 or isinstance(node, list) != (m[1] == "]"):
                return None
            open_.pop()
        elif m[1] in (",", ":"):
            continue
        else:
            try:
                new = [] if m[1] == "[" else {} if m[1] == "{" else json.loads(m[2])
            except ValueError:
                return None
            if isinstance(node, list):
                node.append(new)
            elif names:
                node[names.pop()] = new
            elif isinstance(new, str):
                names.append(new)
                continue
            else:
                return None
            if m[1]:
                open_.append((new, []))
    return top[0] if len(open_) == 1 and len(top) == 1 and not text[at:].strip() else None


class Node:
    """An object or a list of the tree: where it stands, its page, and what its names tell of it, by role, preferred ones first."""

    __slots__ = ("depth", "facts", "inner", "is_object", "page", "parent_path", "step")

    def __init__(self, parent_path: tuple, step, depth: int, page: int, value):
        self.parent_path, self.step, self.depth = parent_path, step, depth
        self.is_object = isinstance(value, dict)
        self.facts: dict[str, list] = {}
        self.inner = []
        for k, v in value.items() if self.is_object else enumerate(value):
            if isinstance(v, (dict, list)):
                self.inner.append((k, v))
            if self.is_object and (known := ROLES.get(k.lower())):
                self.facts.setdefault(known[0], []).append((known[1], k != k.lower(), k, v))
        for facts in self.facts.values():
            facts.sort(key=lambda f: f[:3])
        self.page = self._page(page)

    def values(self, role: str) -> list:
        return [f[3] for f in self.facts.get(role, ())]

    def _page(self, otherwise: int) -> int:
        """The page that it names, from 0, else the given one."""
        found = self.facts.get("page")
        if not found or not isinstance(found[0][3], int) or isinstance(found[0][3], bool):
            return otherwise
        return found[0][3] - any(k.lower() in ONE_BASED for _, _, k, _ in found)

    def score(self) -> tuple[float | None, str]:
        """Its own score and the name it was found under."""
        usable = ((scale(number(v)), SCORE_KEYS[rank]) for rank, _, _, v in self.facts.get("score", ()) if not isinstance(v, (list, dict)))
        return next((x for x in usable if x[0] is not None), (None, ""))

    def text(self) -> str:
        """The first text that isn't empty, then the captions, one for each of their names; a picture's path if there is neither."""
        parts = list(filter(None, (" ".join(strings(v)) for v in self.values("text"))))[:1]
        told = set()
        for rank, _, _, v in self.facts.get("caption", ()):
            if rank not in told:
                told.add(rank)
                parts += strings(v)
        if not parts:
            parts = [f"[图片] {p}" for v in self.values("image")[:1] for p in strings(v)[:1]]
        return "\n".join(parts)

    def kind(self) -> str:
        value = next(iter(self.values("kind")), None)
        if isinstance(value, str) and value.strip():
            return value.strip().lower()
        return f"category_{value}" if isinstance(value, int) and not isinstance(value, bool) else "unknown"

    def box(self) -> dict | None:
        """The box of four numbers, or of the hull of eight."""
        value = next(iter(self.values("box")), None)
        v = [x for x in map(number, value) if x is not None] if isinstance(value, list) else []
        if len(v) == 8:
            v = [min(v[::2]), min(v[1::2]), max(v[::2]), max(v[1::2])]
        return dict(zip(("x0", "y0", "x1", "y1"), v, strict=True)) if len(v) == 4 else None

    def path(self) -> str:
        steps, at = [], (self.parent_path, self.step)
        while at[0] is not None:
            steps.append(str(at[1]))
            at = at[0]
        return "/".join([str(at[1]), *steps[::-1]])

    def row(self, text: str, score: float | None, source: str) -> dict:
        return {"path": self.path(), "page_idx": self.page, "kind": self.kind(), "text": text, "score": score, "source": source, "box": self.box()}


def strings(value) -> list[str]:
    """A text, or a list's texts, stripped, without empty ones."""
    return [x.strip() for x in (value if isinstance(value, list) else [value]) if isinstance(x, str) and x.strip()]


def nodes_of(tree) -> list[Node]:
    """All objects and lists of a tree, each before those in it. Paths are shared with the parents', so any depth takes memory in proportion."""
    root: tuple = (None, "$")
    todo: list[tuple] = []
    pages = tree if isinstance(tree, list) else None
    if isinstance(tree, dict):
        name = next((k for k in tree if k.lower() in PAGE_LISTS and isinstance(tree[k], list)), None)
        if name is None:
            todo = [(None, "$", 0, 0, tree)]
        else:
            root, pages = (root, name), tree[name]
    todo += [(root, i, 0, i, x) for i, x in enumerate(pages or ()) if isinstance(x, (dict, list))]
    todo.reverse()
    out = []
    while todo:
        parent_path, step, depth, page, value = todo.pop()
        node = Node(parent_path, step, depth, page, value)
        out.append(node)
        here = (parent_path, step)
        todo += [(here, k, depth + 1, node.page, v) for k, v in reversed(node.inner)]
        node.inner = [k for k, v in node.inner if isinstance(v, dict)]
    return out


def scored_of(value: str | None) -> list[dict]:
    """Every object of a JSON text that has a score of its own and a text, its own or that of the objects up to TEXT_DEPTH levels in it."""
    nodes, out = nodes_of(read_json(value)), []
    for i, node in enumerate(nodes):
        score, source = node.score()
        if score is None:
            continue
        text = node.text()
        if not text:
            below, k = [], i + 1
            while k < len(nodes) and nodes[k].depth > node.depth:
                if nodes[k].depth <= node.depth + TEXT_DEPTH:
                    below.append(nodes[k].text())
                k += 1
            text = " ".join(filter(None, below))
        if text:
            out.append(node.row(text, score, source))
    return out


def items_of(value: str | None) -> list[dict]:
    """The objects of a content list that have a text; scores are their own or a child object's."""
    tree, out = read_json(value), []
    for i, item in enumerate(x for x in (tree if isinstance(tree, list) else []) if isinstance(x, dict)):
        node = Node((None, "$"), i, 0, 0, item)
        if text := node.text():
            children = ((f"{k}.", Node((), k, 1, 0, v)) for k, v in node.inner if isinstance(v, dict))
            found = ((score, prefix + name) for prefix, n in [("", node), *children] for score, name in [n.score()] if score is not None)
            out.append(node.row(text, *next(found, (None, "none"))))
    return out


def _nodes(documents: DataFrame, key: str, read) -> DataFrame:
    ship(documents.sparkSession)
    nodes = F.pandas_udf(lambda values: pd.Series([read(v) for v in values], dtype="object"), f"array<{NODE}>")
    return documents.select(key, F.posexplode(nodes("value")).alias("ord", "n")).select(key, "ord", "n.*")


def scored_nodes(documents: DataFrame) -> DataFrame:
    """(doc, ord, path, page_idx, kind, text, score, source, box) of every object in JSON documents (doc, value) that has a
    score and a text, at any depth. What is no JSON gives no rows."""
    return _nodes(documents, "doc", scored_of)


def content_segments(lists: DataFrame) -> DataFrame:
    """(bundle, ord, segment_id, page_idx, kind, text, score, source, box) of content lists (bundle, value): one row for each
    item with a text, in order; ids begin anew in each bundle. Items without a score keep null, for layout_scored."""
    return _nodes(lists, "bundle", items_of).withColumn("segment_id", F.format_string("S%05d", F.col("ord") + 1)).drop("path")


def layout_scored(segments: DataFrame, layout: DataFrame, systems: DataFrame) -> DataFrame:
    """Segments whose missing scores come from layout boxes (bundle, page, box, score, source) that overlap them.

    systems: (bundle, system, width, height), the coordinate system of the segments' boxes (geometry.coordinate_systems);
    layout boxes are on the scale 0 to 1. A segment without a box, or of an unknown system, keeps null.
    """
    at = segments.join(systems, "bundle", "left").withColumn("unit", to_unit(F.col("box"), F.col("system"), F.col("width"), F.col("height")))
    asking = at.where("score is null and unit is not null").select(F.struct("bundle", "segment_id").alias("target_id"), F.struct("bundle", F.col("page_idx").alias("page")).alias("page"), F.col("unit").alias("box"))
    found = layout_scores(asking, layout.select(F.struct("bundle", "page").alias("page"), "box", "score", F.col("source")))
    found = found.select("target_id.*", F.col("score").alias("l_score"), F.col("source").alias("l_source"), "hits")
    out = segments.join(found, ["bundle", "segment_id"], "left")
    return out.select(*[c for c in segments.columns if c not in ("score", "source")], F.coalesce("score", "l_score").alias("score"), F.when(F.col("score").isNull() & F.col("l_score").isNotNull(), F.col("l_source")).otherwise(F.col("source")).alias("source"), F.coalesce("hits", F.lit(0)).alias("lines"))


def parsed_page_count(results: DataFrame) -> DataFrame:
    """(bundle, parsed_pages) of results (bundle, content, model), both JSON: one more than the content list's last page, else
    the number of the model's pages; null if neither says it."""
    content, model = F.try_parse_json("content"), F.try_parse_json("model")
    listed = F.from_json("content", "array<struct<page_idx:int>>")
    last = F.array_max(F.transform(listed, lambda x: x["page_idx"]))
    sized = lambda path: F.nullif(F.size(F.try_variant_get(model, path, "array<variant>")), F.lit(0))
    known = F.coalesce(*[F.when(F.coalesce(sized(p), F.lit(-1)) > 0, sized(p)) for p in ("$", *(f"$.{k}" for k in COUNT_KEYS))])
    return results.select("bundle", F.coalesce(F.when(content.isNotNull(), last + 1), known).alias("parsed_pages"))


def _page_starts(lines: DataFrame, file: str) -> DataFrame:
    """lines (file, line_no, pages) exploded to (file, page, p): pages run on across a file's lines. Only counts meet by file."""
    before = Window.partitionBy(file).orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1)
    counts = lines.select(file, "line_no", F.size("pages").alias("n"))
    starts = counts.select(F.col(file).alias("__file"), F.col("line_no").alias("__line"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__start"))
    placed = lines.join(starts, F.col(file).eqNullSafe(F.col("__file")) & (F.col("line_no") == F.col("__line")))
    return placed.select(file, "__start", F.posexplode("pages").alias("__i", "p")).select(file, (F.col("__start") + F.col("__i")).alias("page"), "p")


def result_pages(lines: DataFrame) -> DataFrame:
    """(file, page_idx, text, images) of result lines (file, line_no, value): page numbers run on across the lines of a file.

    A line that is no JSON raises; blank lines are skipped.
    """
    shape = "struct<result:struct<layoutParsingResults:array<struct<markdown:struct<text:string,images:map<string,string>>>>>>"
    rows = lines.where(F.trim("value") != "").select("file", "line_no", F.from_json("value", shape, {"mode": "FAILFAST"})["result"]["layoutParsingResults"].alias("pages"))
    pages = _page_starts(rows.where("pages is not null"), "file")
    return pages.select("file", F.col("page").cast("int").alias("page_idx"), F.coalesce("p.markdown.text", F.lit("")).alias("text"), "p.markdown.images")


def layout_index(model: DataFrame, middle: DataFrame) -> DataFrame:
    """Layout boxes (bundle, page, box, score, source) of the model's results; of the middle ones for bundles without any."""
    ok = lambda df: df.where("box is not null and score is not null")
    return ok(model).unionByName(ok(middle).join(ok(model).select("bundle").distinct(), "bundle", "left_anti"))


def parsed_boxes(results: DataFrame) -> DataFrame:
    """(bundle, page, box, width, height, label, ord) of the blocks of result lines (bundle, line_no, value): those of each page's
    parsed layout, in pixels of the page's picture; pages run on across a bundle's lines.

    Only counts of pages meet by bundle; a line that is no JSON, and a block without a box, give no rows.
    """
    shape = "struct<result:struct<layoutParsingResults:array<struct<prunedResult:struct<width:double,height:double,parsing_res_list:array<struct<block_label:string,block_bbox:array<double>>>>>>>>"
    rows = results.select("bundle", "line_no", F.from_json("value", shape)["result"]["layoutParsingResults"].alias("pages")).where("pages is not null")
    pages = _page_starts(rows, "bundle")
    blocks = pages.select("bundle", "page", "p.prunedResult.width", "p.prunedResult.height", F.posexplode("p.prunedResult.parsing_res_list").alias("ord", "b"))
    return blocks.select("bundle", "page", bbox(F.col("b.block_bbox")).alias("box"), "width", "height", F.col("b.block_label").alias("label"), "ord").where("box is not null")


def scored_layout(nodes: DataFrame) -> DataFrame:
    """Layout boxes (bundle, page, box, score, source) on the scale 0 to 1 of scored nodes (bundle, page_idx, box, score, source), whose
    coordinate system is that of their bundle; bundles of an unknown system give none."""
    known = nodes.where("box is not null and score is not null")
    none = F.lit(None).cast("double")
    systems = coordinate_systems(known.select("bundle", "box", none.alias("width"), none.alias("height")))
    unit = to_unit(F.col("box"), F.col("system"), none, none)
    return known.join(systems, "bundle").select("bundle", F.col("page_idx").alias("page"), unit.alias("box"), "score", "source").where("box is not null")
