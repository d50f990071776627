"""Work orders: what a reader has to look at before a book goes on, and whether it can."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.functions.markup import is_written
from quire.functions.text import excerpt
from quire.operators.pages import work_pages


def order_segments(segments: DataFrame, pages: DataFrame, threshold: float = 0.6, limit: int = 200, width: int = 400) -> DataFrame:
    """(book_id, nth, segment_id, page_no, score, excerpt): each book's least certain segments (book_id, segment_id, page_no, score, text)
    below the threshold, limit of them at most, with the text around them on their page (book_id, page_no, text).

    The limit is the order's feature; it is applied before pages are joined, so only pages of these segments are read on.
    """
    order = Window.partitionBy("book_id").orderBy("score", "page_no", "segment_id")
    low = segments.where(F.col("score") < threshold).withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= limit)
    text = pages.select("book_id", "page_no", F.col("text").alias("__page"))
    at = low.join(text, ["book_id", "page_no"], "left")
    return at.select("book_id", "nth", "segment_id", "page_no", "score", excerpt(F.coalesce("__page", F.lit("")), F.col("text"), width).alias("excerpt"))


def work_order(segments: DataFrame, pages: DataFrame, seams: DataFrame, counts: DataFrame, threshold: float = 0.6, limit: int = 200, around: int = 1) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The segments of the order, the pages to look at (book_id, page_no, is_seam), and counts (book_id, segments, low, pages, seams)."""
    chosen = order_segments(segments, pages, threshold, limit)
    look = work_pages(chosen.select("book_id", "page_no"), seams, counts, around)
    n = lambda df, name: df.groupBy("book_id").agg(F.count("*").alias(name))
    summary = counts.select("book_id")
    for df, name in ((segments, "segments"), (chosen, "low"), (look, "pages"), (seams, "seams")):
        summary = summary.join(n(df, name), "book_id", "left").na.fill(0, [name])
    return chosen, look, summary


def composed(chapters: DataFrame) -> DataFrame:
    """(book_id, chapters, written, ready) of chapter files (book_id, name, text): samples and empty files aren't written; one that is makes a book ready."""
    done = F.coalesce(is_written(F.col("text")) & (F.trim("text") != ""), F.lit(False))
    c = chapters.groupBy("book_id").agg(F.count("*").alias("chapters"), F.count_if(done).alias("written"))
    return c.withColumn("ready", F.col("written") > 0)
