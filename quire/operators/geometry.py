"""Boxes and confidence: parsing, coordinate systems, and attaching layout scores to text by overlap."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.storage import stored

#: Share of the text's box or of the layout box that must be covered.
OVERLAP = 0.5


def score_norm(c: Column) -> Column:
    """0 to 1 as it is, above 1 to 100 as percent, else null; so is a boolean, as a column or as a text."""
    text = c.cast("string")
    v = F.when(~F.lower(text).isin("true", "false"), text.try_cast("double"))
    return F.when((v >= 0) & (v <= 1), v).when((v > 1) & (v <= 100), v / 100)


def bbox(values: Column) -> Column:
    """struct<x0, y0, x1, y1> of 4 numbers, or of the hull of 8 (a polygon); else null."""
    v = F.filter(F.transform(values, lambda x: x.cast("double")), lambda x: x.isNotNull())
    xs, ys = F.filter(v, lambda x, i: i % 2 == 0), F.filter(v, lambda x, i: i % 2 == 1)
    four = F.struct(v[0].alias("x0"), v[1].alias("y0"), v[2].alias("x1"), v[3].alias("y1"))
    hull = F.struct(F.array_min(xs).alias("x0"), F.array_min(ys).alias("y0"), F.array_max(xs).alias("x1"), F.array_max(ys).alias("y1"))
    return F.when(F.size(v) == 4, four).when(F.size(v) == 8, hull)


def area(b: Column) -> Column:
    return F.greatest(F.lit(0.0), b["x1"] - b["x0"]) * F.greatest(F.lit(0.0), b["y1"] - b["y0"])


def intersection(a: Column, b: Column) -> Column:
    w = F.least(a["x1"], b["x1"]) - F.greatest(a["x0"], b["x0"])
    h = F.least(a["y1"], b["y1"]) - F.greatest(a["y0"], b["y0"])
    return F.greatest(F.lit(0.0), w) * F.greatest(F.lit(0.0), h)


def iou(a: Column, b: Column) -> Column:
    common = intersection(a, b)
    union = area(a) + area(b) - common
    return F.when(union > 0, common / union).otherwise(0.0)


def top(b: Column) -> Column:
    return F.greatest(b["x0"], b["y0"], b["x1"], b["y1"])


def coordinate_systems(boxes: DataFrame) -> DataFrame:
    """(bundle, system) of boxes (bundle, box, width, height): unit, pixels, thousand, or null if unknown.

    Decided for a whole bundle: a page with little on it would be taken for another system than its book's.
    """
    scaled = F.when((F.col("width") > 1) & (F.col("height") > 1), F.greatest(F.col("box.x0") / F.col("width"), F.col("box.y0") / F.col("height"), F.col("box.x1") / F.col("width"), F.col("box.y1") / F.col("height")))
    g = boxes.where("box is not null").groupBy("bundle").agg(F.max(top(F.col("box"))).alias("top"), F.max(scaled).alias("scaled"))
    return g.select("bundle", F.when(F.col("top") <= 1.5, "unit").when(F.col("scaled") <= 1.05, "pixels").when(F.col("top") <= 1000, "thousand").alias("system"))


def to_unit(box: Column, system: Column, width: Column, height: Column) -> Column:
    """A box on the scale 0 to 1; null if the system is unknown: no score is better than a wrong one."""
    x = F.when(system == "unit", 1.0).when(system == "pixels", width).when(system == "thousand", 1000.0)
    y = F.when(system == "unit", 1.0).when(system == "pixels", height).when(system == "thousand", 1000.0)
    return F.when(x.isNotNull() & box.isNotNull(), F.struct((box["x0"] / x).alias("x0"), (box["y0"] / y).alias("y0"), (box["x1"] / x).alias("x1"), (box["y1"] / y).alias("y1")))


#: Cells of a page's grid, in each direction, at most.
MOST_CELLS = 256
#: Layout boxes and targets of a cell that are compared in one block, about.
BOXES, TARGETS = 4096, 16_384


def _cells(box: Column, n: Column) -> Column:
    """The cells that a box touches on a page of n x n cells, as array<int>; boxes outside of 0 to 1 are in the cells at the edge."""
    at = lambda v: F.least(n - 1, F.greatest(F.lit(0), F.floor(v * n))).cast("int")
    down = F.sequence(at(box["y0"]), F.greatest(at(box["y0"]), at(box["y1"])))
    across = F.sequence(at(box["x0"]), F.greatest(at(box["x0"]), at(box["x1"])))
    return F.flatten(F.transform(down, lambda y: F.transform(across, lambda x: y * n.cast("int") + x)))


def layout_scores(targets: DataFrame, layout: DataFrame) -> DataFrame:
    """(target_id, score, source, hits) of targets (target_id, page, box) and layout boxes (page, box, score, source), on the scale 0 to 1.

    A layout box counts if half of it or half of the target is covered; the lowest score counts, since a doubtful line makes a
    paragraph worth a look. A spatial join: boxes of both sides are copied to the cells of their page's grid that they touch, and meet
    by page and cell; a pair that meets in several cells counts in the one where its common part begins. The grid is as fine as the page's
    layout boxes are many, but its cells not smaller than they are on average: a page's work grows with its boxes, not with their pairs.
    Where the boxes lie in few cells all the same, pairs are compared in blocks of bounded size, each with each: a task's memory doesn't grow with
    the pairs. Boxes are numbered in the order of their scores, so what is kept of a target's pairs is two numbers, which need no sort.
    """
    ranked = layout.select("page", F.col("box").alias("b"), "score", "source").where("b is not null").orderBy(F.col("score").asc_nulls_last(), "source")
    ranked = stored(ranked.withColumn("nth", F.monotonically_increasing_id()), "boxes")
    wide = F.avg(F.greatest(F.lit(1e-6), F.col("b.x1") - F.col("b.x0"), F.col("b.y1") - F.col("b.y0")))
    sides = ranked.groupBy(F.col("page").alias("of")).agg(F.greatest(F.lit(1), F.least(F.lit(MOST_CELLS), F.ceil(F.sqrt(F.count("*"))), F.floor(1 / wide))).cast("int").alias("n"))
    edge = lambda v: F.least(F.col("n") - 1, F.greatest(F.lit(0), F.floor(v * F.col("n")))).cast("int")

    def on(df: DataFrame, box: str, half: Callable[[Column], Column]) -> DataFrame:
        b = F.col(box)
        at = df.join(sides, F.col("page") == F.col("of")).withColumn("cell", F.explode(_cells(b, F.col("n"))))
        plain = [b[k].alias(f"{box}_{k}") for k in ("x0", "y0", "x1", "y1")]
        return at.select(*[c for c in df.columns if c != box], "n", "cell", *plain, half(area(b)).alias(f"{box}_half"), edge(b["x0"]).alias(f"{box}_x"), edge(b["y0"]).alias(f"{box}_y"))

    # What a pair's common part must reach: half of the target, if it has an area, or half of the layout box.
    t = on(targets.select("target_id", "page", F.col("box").alias("t")).where("t is not null"), "t", lambda a: F.when(a > 0, OVERLAP * a).otherwise(float("inf"))).drop("n").withColumnsRenamed({"page": "p", "cell": "c"})
    b = on(ranked.select("page", "b", "nth"), "b", lambda a: OVERLAP * F.greatest(a, F.lit(1e-9)))
    count = lambda n, size: F.ceil(n / size).cast("int")
    crowds = t.groupBy("p", "c").agg(count(F.count("*"), TARGETS).alias("ts")).join(b.groupBy("page", "cell").agg(count(F.count("*"), BOXES).alias("bs")), (F.col("p") == F.col("page")) & (F.col("c") == F.col("cell")))
    # Of all cells only the crowded are kept: one row for thousands of boxes.
    crowds = stored(crowds.where("ts > 1 or bs > 1").select(F.col("p").alias("at"), F.col("c").alias("in"), "ts", "bs"), "crowds")

    def cut(df: DataFrame, page: str, cell: str, key: str, own: str, others: str) -> DataFrame:
        """The rows with their own block's number, and once for each block of the other side."""
        found = df.join(crowds, (F.col(page) == F.col("at")) & (F.col(cell) == F.col("in")), "left")
        mine = F.pmod(F.xxhash64(key), F.coalesce(own, F.lit(1))).cast("int")
        return found.select(*df.columns, mine.alias(f"{own}_own"), F.explode(F.sequence(F.lit(0), F.coalesce(others, F.lit(1)) - 1)).alias(f"{others}_met"))

    t, b = cut(t, "p", "c", "target_id", "ts", "bs"), cut(b, "page", "cell", "nth", "bs", "ts")
    box = lambda x: F.struct(*[F.col(f"{x}_{k}").alias(k) for k in ("x0", "y0", "x1", "y1")])
    here = F.col("cell") == F.greatest("t_y", "b_y") * F.col("n") + F.greatest("t_x", "b_x")
    hit = intersection(box("t"), box("b")) >= F.least("t_half", "b_half")
    j = t.join(b, (F.col("p") == F.col("page")) & (F.col("c") == F.col("cell")) & (F.col("ts_own") == F.col("ts_met")) & (F.col("bs_met") == F.col("bs_own")) & here & hit)
    best = j.groupBy("target_id").agg(F.min("nth").alias("best"), F.count("*").alias("hits"))
    named = ranked.select(F.col("nth").alias("best"), "score", "source")
    return best.join(named, "best").select("target_id", "score", F.concat(F.lit("layout:"), F.when(F.col("score").isNotNull(), F.col("source"))).alias("source"), "hits")


def low_confidence(segments: DataFrame, threshold: float = 0.6, limit: int = 200) -> DataFrame:
    """The limit least certain segments below the threshold; unscored ones are left out. A top-k report."""
    return segments.where(F.col("score") < threshold).orderBy("score", "page_idx", "ord").limit(limit)


def crop_box(box: Column, width: int, height: int, margin: int = 10) -> Column:
    """A unit box as whole pixels with a margin, inside the picture."""
    lo = lambda v, n: F.greatest(F.lit(0), F.floor(v * n) - margin).cast("int")
    hi = lambda v, n: F.least(F.lit(n), F.ceil(v * n) + margin).cast("int")
    return F.struct(lo(box["x0"], width).alias("left"), lo(box["y0"], height).alias("top"), hi(box["x1"], width).alias("right"), hi(box["y1"], height).alias("bottom"))


def representative_size(pages: DataFrame) -> DataFrame:
    """(bundle, width, height): the first known page size of each bundle."""
    known = pages.where("width > 0 and height > 0")
    first = Window.partitionBy("bundle").orderBy("page")
    return known.withColumn("nth", F.row_number().over(first)).where("nth = 1").select("bundle", "width", "height")
