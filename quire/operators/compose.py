"""From outlines and lines to chapters: matching headings, packing chapters, rendering parts."""

from __future__ import annotations

from bisect import bisect_right
from collections import defaultdict
from itertools import groupby

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions.markup import table_attributes
from quire.functions.text import entities_escaped, ordered_concat, title_key, ustrip
from quire.operators.lines import HEADING, heading_level, toc_tail
from quire.shipping import ship
from quire.storage import stored


def flattened_outline(entries: DataFrame, keep_broken: bool = False, top_only: bool = False) -> DataFrame:
    """(book_id, seq, level, title, page) of outline entries (book_id, seq, level, title, page): titles stripped; entries without
    a title or a page are left out, or kept with page -1. top_only: those of the first level, page 0 where there is none."""
    if top_only:
        return entries.where("level = 1").withColumn("title", ustrip(F.coalesce("title", F.lit("")))).withColumn("page", F.coalesce("page", F.lit(0)))
    e = entries.withColumn("title", ustrip(F.coalesce("title", F.lit(""))))
    if keep_broken:
        return e.withColumn("page", F.coalesce("page", F.lit(-1)))
    return e.where("title <> '' and page is not null")


def packed_chapters(chapters: DataFrame, max_pages: int) -> DataFrame:
    """(book_id, seq, part): consecutive chapters (book_id, seq, n_pages) share a part while its pages stay within max_pages; a
    longer chapter has a part of its own. Where a part ends depends on all parts before, so a book is one sequential pass, over
    two numbers for each chapter."""
    ship(chapters.sparkSession)

    def fold(book: pd.DataFrame) -> pd.DataFrame:
        book = book.sort_values("seq")
        part = used = 0
        parts = []
        for n in book["n_pages"].tolist():
            if used and used + n > max_pages:
                part, used = part + 1, 0
            used += n
            parts.append(part)
        return pd.DataFrame({"book_id": book["book_id"], "seq": book["seq"], "part": pd.Series(parts, index=book.index, dtype="int32")})

    rows = chapters.select(F.col("book_id").cast("string").alias("book_id"), F.col("seq").cast("long").alias("seq"), F.col("n_pages").cast("long").alias("n_pages"))
    return rows.groupBy("book_id").applyInPandas(fold, "book_id string, seq long, part int")


#: Letters of a common beginning, and the length beyond which one title may stand inside the other; lengths that differ by less are alike.
BEGIN, INSIDE = 8, 12
#: Short headings up to this number are broadcast.
FEW = 65_536
#: No heading begins or reads like this entry.
NONE = -(1 << 62)


def inside(keys: DataFrame, headings: DataFrame) -> DataFrame:
    """(book_id, entry, of) of distinct long titles (book_id, key, entry) and headings (book_id, heading, of) that stand inside each other.

    By equal joins on INSIDE + 1 letters, or on the whole of a shorter heading: the inner title's first letters stand in the outer one.
    Both tables are read several times, so they should be stored. Titles' pieces are many rows of one, which Spark's sizes don't tell, so
    they are never broadcast; short headings, of which there are few as a rule, are, so pieces of their lengths stay where they are made.
    """
    most = INSIDE + 1
    long, long_headings, short = keys.where(F.length("key") > INSIDE), headings.where(F.length("heading") > INSIDE), headings.where(F.length("heading") <= INSIDE)
    short = (F.broadcast(short) if short.count() <= FEW else short.hint("merge")).withColumnRenamed("heading", "letters")
    sizes = short.agg(F.collect_set(F.length("letters")).alias("sizes"))

    def pieces(c: str, sizes: Column) -> Column:
        starts = lambda k: F.when(F.length(c) >= k, F.sequence(F.lit(1), F.length(c) - k + 1)).otherwise(F.array().cast("array<int>"))
        return F.explode(F.array_distinct(F.flatten(F.transform(sizes, lambda k: F.transform(starts(k), lambda i: F.substr(F.col(c), i, k))))))

    both, whole = ["book_id", "letters"], F.array(F.lit(most))
    begin = lambda df, c: df.withColumn("letters", F.left(c, F.lit(most))).hint("merge")
    within = long_headings.withColumn("letters", pieces("heading", whole)).join(begin(long, "key"), both)
    around = long.withColumn("letters", pieces("key", whole)).join(begin(long_headings, "heading"), both)
    # sizes is one row, of 12 numbers at most; a piece of such a length is the whole heading.
    shorter = long.crossJoin(F.broadcast(sizes)).withColumn("letters", pieces("key", F.col("sizes"))).drop("sizes").join(short, both)
    found = within.where(F.contains("heading", "key")).select("book_id", "entry", "of").unionByName(around.where(F.contains("key", "heading")).select("book_id", "entry", "of"))
    return found.unionByName(shorter.select("book_id", "entry", "of")).distinct()


def outline_lines(outline: DataFrame, headings: DataFrame) -> DataFrame:
    """(book_id, seq, line_no): for each outline entry (book_id, seq, title) the next heading (book_id, line_no, title) behind the
    one before that matches; null if none does. Titles match that are equal, have a common beginning and like length, or of which a long
    entry stands inside the heading or around it.

    Where an entry goes depends on all before it, so a book is one sequential pass. It sees a few numbers for each entry and heading:
    titles are numbered by their first line, those inside each other are linked, title by title, and a common beginning is looked up
    with the lengths that are alike. Pairs of entries and headings are made nowhere. Stored titles are smaller as files than in
    memory, so none of these tables is broadcast.
    """
    ship(outline.sparkSession)
    a = outline.select("book_id", F.col("seq").cast("long").alias("seq"), title_key(F.col("title")).alias("key")).where("key <> '' and book_id is not null")
    b = headings.select("book_id", F.col("line_no").cast("long").alias("line_no"), title_key(F.col("title")).alias("heading")).where("heading <> '' and book_id is not null")
    keys = stored(a.groupBy("book_id", "key").agg(F.min("seq").alias("entry")), "keys")
    titles = stored(b.groupBy("book_id", "heading").agg(F.min("line_no").alias("of")), "titles")
    begins = titles.where(F.length("heading") >= BEGIN).groupBy("book_id", F.left("heading", F.lit(BEGIN)).alias("letters")).agg(F.min("of").alias("begin"))
    links = inside(keys, titles).unionByName(keys.join(titles.withColumnRenamed("heading", "key").hint("merge"), ["book_id", "key"]).select("book_id", "entry", "of"))
    begun = lambda df, c: df.withColumn("letters", F.left(c, F.lit(BEGIN))).join(begins.hint("merge"), ["book_id", "letters"], "left")
    asks = begun(a.join(keys.hint("merge"), ["book_id", "key"]), "key").select("book_id", F.lit(0).alias("what"), F.col("seq").alias("x"), F.col("entry").alias("k"), F.coalesce("begin", F.lit(NONE)).alias("p"), F.length("key").cast("long").alias("n"))
    has = begun(b.join(titles.hint("merge"), ["book_id", "heading"]), "heading").select("book_id", F.lit(1).alias("what"), F.col("line_no").alias("x"), F.col("of").alias("k"), F.coalesce("begin", F.lit(NONE)).alias("p"), F.length("heading").cast("long").alias("n"))
    linked = links.select("book_id", F.lit(2).alias("what"), F.col("of").alias("x"), F.col("entry").alias("k"), F.lit(NONE).alias("p"), F.lit(0).cast("long").alias("n"))

    def scan(book: pd.DataFrame) -> pd.DataFrame:
        by_title, by_begin, inner = defaultdict(list), defaultdict(lambda: defaultdict(list)), defaultdict(list)
        part = lambda what: book[book["what"] == what].sort_values("x")[["x", "k", "p", "n"]].itertuples(index=False, name=None)
        for line, title, begin, n in part(1):
            by_title[title].append(line)
            if begin != NONE:
                by_begin[begin][n].append(line)
        for title, entry, _, _ in part(2):
            inner[entry].append(title)
        found, last = [], -1
        for seq, entries in groupby(part(0), key=lambda e: e[0]):
            lines = []
            for _, entry, begin, n in entries:
                lists = [by_title[title] for title in inner.get(entry, ())]
                if begin != NONE:
                    lists += [x for m, x in by_begin[begin].items() if abs(n - m) < INSIDE]
                lines += [x[at] for x in lists if (at := bisect_right(x, last)) < len(x)]
            if lines:
                last = min(lines)
                found.append((seq, last))
        out = pd.DataFrame(found, columns=["seq", "line_no"]).astype("int64")
        out.insert(0, "book_id", book["book_id"].iloc[0])
        return out

    lines = asks.unionByName(has).unionByName(linked).groupBy("book_id").applyInPandas(scan, "book_id string, seq long, line_no long")
    return outline.select("book_id", F.col("seq").cast("long").alias("seq")).join(lines.hint("merge"), ["book_id", "seq"], "left")


def plan(found: DataFrame, lengths: DataFrame) -> DataFrame:
    """(book_id, seq, start_line, end_line): the parts between found lines (outline_lines); the last ends with the book."""
    order = Window.partitionBy("book_id").orderBy("line_no")
    f = found.where("line_no is not null").withColumn("next", F.lead("line_no").over(order)).join(lengths, "book_id")
    return f.select("book_id", "seq", F.col("line_no").alias("start_line"), F.coalesce(F.col("next") - 1, F.col("n_lines")).alias("end_line"))


def toc_levels(entries: DataFrame) -> DataFrame:
    """Entries (part_level, level) with the level they have in the whole book."""
    return entries.withColumn("book_level", F.col("part_level") + F.col("level") - 1)


def inline(text: Column) -> Column:
    """Escaped text with `code` marked; math between dollars is kept as code, unless the number of dollars is odd."""
    safe = entities_escaped(text)
    code = F.regexp_replace(safe, "`([^`]+)`", "<code>$1</code>")
    even = F.regexp_count(text, F.lit(r"\$")) % 2 == 0
    return F.when(even, F.regexp_replace(code, r"\$([^$]+)\$", '<code class="math">$1</code>')).otherwise(code)


def rendered_table(html: Column) -> Column:
    """A parsed table with sound attributes and inline markup in its cells; tags stay as they are."""
    parts = F.regexp_extract_all(table_attributes(html), F.lit(r"<[^>]+>|[^<]+|<"), F.lit(0))
    return F.array_join(F.transform(parts, lambda x: F.when(x.rlike("^<[^>]+>$"), x).otherwise(inline(x))), "")


def anchors(headings: DataFrame) -> DataFrame:
    """headings (part, ord, ...) with an anchor: s-1, s-2 ... within each part."""
    return headings.withColumn("anchor", F.concat(F.lit("s-"), F.row_number().over(Window.partitionBy("part").orderBy("ord"))))


def without_own_titles(blocks: DataFrame, parts: DataFrame) -> DataFrame:
    """Blocks (part, ord, text) without the headings at a part's beginning that repeat its title: the title itself, those the plan
    names (strip, an array), or a chapter number with or without it. parts: part, title, number, strip."""
    p = parts.select("part", "title", F.coalesce("strip", F.array().cast("array<string>")).alias("strip"), F.concat(F.lit("第"), F.col("number").cast("string"), F.lit("章 "), "title").alias("numbered"))
    b = blocks.join(p, "part", "left")
    label = F.trim(F.regexp_extract("text", HEADING, 2))
    own = F.col("text").rlike(HEADING) & ((label == F.col("title")) | F.array_contains("strip", label) | (label == F.col("numbered")) | label.rlike(r"^第\s*\d+\s*章$"))
    body = b.where(~F.coalesce(own, F.lit(False))).groupBy("part").agg(F.min("ord").alias("body"))
    return b.join(body, "part").where("ord >= body").select(*blocks.columns)


def special_lines(lines: DataFrame) -> DataFrame:
    """(part, ord, html) of the lines (part, ord, kind, line) of pages that aren't running text: title pages, printed contents,
    indexes. Blank lines and headings give nothing."""
    t = lines.withColumn("line", ustrip(F.col("line"))).where((F.col("line") != "") & ~F.col("line").rlike(r"^#{1,6}\s"))
    p = lambda name, inner: F.concat(F.lit(f'<p class="{name}">'), inner, F.lit("</p>"))
    title, page = toc_tail(F.col("line"))["title"], toc_tail(F.col("line"))["page"]
    paged = F.concat(inline(F.trim(title)), F.lit(' <span class="toc-page">'), page, F.lit("</span>"))
    entry = F.when(F.trim(title) == "", p("toc-item", inline(F.col("line")))).when(F.col("line").rlike(r"^第\s*\d+\s*章"), p("toc-item toc-chapter", paged)).otherwise(p("toc-item", paged))
    return t.select("part", "ord", F.when(F.col("kind") == "title", p("title-line", inline(F.col("line")))).when(F.col("kind") == "toc", entry).otherwise(p("index-line", inline(F.col("line")))).alias("html"))


def rendered_blocks(blocks: DataFrame, lines: DataFrame) -> DataFrame:
    """(doc_id, start_line, html) of blocks (doc_id, start_line, end_line, kind) over lines (doc_id, line_no, line).

    Lines find their block by an as-of window; a block is one element: paragraphs, listings, lists, headings, math and html.
    """
    starts = blocks.select("doc_id", F.col("start_line").alias("line_no"), F.struct("start_line", "end_line", "kind").alias("b"), F.lit(None).cast("string").alias("line"))
    rows = lines.select("doc_id", "line_no", F.lit(None).cast(starts.schema["b"].dataType).alias("b"), "line").unionByName(starts)
    order = Window.partitionBy("doc_id").orderBy("line_no", F.col("b").isNull()).rowsBetween(Window.unboundedPreceding, 0)
    held = rows.withColumn("b", F.last("b", ignorenulls=True).over(order)).where("line is not null and line_no <= b.end_line")
    text = ustrip(F.col("line"))
    kind = F.col("b.kind")
    title = F.regexp_replace(text, r"^#{1,6}\s+", "")
    level = F.coalesce(heading_level(title), F.lit(4)).cast("string")
    piece = F.when(kind == "code", entities_escaped(F.col("line"))).when(kind == "bullets", F.concat(F.lit("<li>"), inline(F.regexp_replace(text, r"^([•·]\s*|-\s+|☐\s*|□\s*)", "")), F.lit("</li>"))).when(kind == "heading", F.concat(F.lit("<h"), level, F.lit(">"), inline(title), F.lit("</h"), level, F.lit(">"))).when(kind == "html", text).otherwise(inline(text))
    held = held.withColumn("piece", piece).where((text != "") | (kind == "code")).withColumn("kind", kind).withColumn("start_line", F.col("b.start_line"))
    body = held.groupBy("doc_id", "start_line", "kind").agg(ordered_concat("line_no", "piece", "\n").alias("body"))
    html = F.when(F.col("kind") == "code", F.concat(F.lit("<pre><code>"), "body", F.lit("</code></pre>"))).when(F.col("kind") == "bullets", F.concat(F.lit("<ul>"), "body", F.lit("</ul>"))).when(F.col("kind").isin("heading", "html"), F.col("body")).when(F.col("kind") == "math", F.concat(F.lit('<p class="math">'), "body", F.lit("</p>"))).otherwise(F.concat(F.lit("<p>"), "body", F.lit("</p>")))
    return body.select("doc_id", "start_line", html.alias("html"))


def chapters(rendered: DataFrame, titles: DataFrame) -> DataFrame:
    """(doc_id, xhtml): a document for each rendered text; titles: doc_id, title."""
    body = rendered.groupBy("doc_id").agg(ordered_concat("start_line", "html", "\n").alias("body"))
    t = entities_escaped(F.coalesce("title", F.lit("Untitled")))
    head = F.concat(F.lit('<?xml version="1.0" encoding="utf-8"?>\n<html xmlns="http://www.w3.org/1999/xhtml"><head><title>'), t, F.lit("</title></head><body>\n"))
    return body.join(titles, "doc_id", "left").select("doc_id", F.concat(head, "body", F.lit("\n</body></html>\n")).alias("xhtml"))


def rewritten(text: Column, needles: Column) -> Column:
    """text with references replaced: needles is array<struct<from, to>>; longer ones first, so that none cuts into another."""
    longest = F.array_sort(needles, lambda a, b: F.when(F.length(a["from"]) > F.length(b["from"]), -1).when(F.length(a["from"]) < F.length(b["from"]), 1).when(a["from"] < b["from"], -1).otherwise(F.when(a["from"] > b["from"], 1).otherwise(0)))
    return F.aggregate(longest, text, lambda acc, n: F.replace(acc, n["from"], n["to"]))


def verified_joins(breaks: DataFrame, layer: DataFrame) -> DataFrame:
    """Page breaks (book_id, page_no, next_no, left, right) that the text layer (book_id, page_no, text) bears out: the end of the
    left page and the beginning of the right one stand there too, and neither looks like a listing. sep is empty after a hyphen."""
    squeeze = lambda c: F.regexp_replace(c, r"\s+", "")
    listing = r"[;{}]|[<>=]=|->|^\s*[#$%]\s"
    b = breaks.where(F.col("left").rlike(r"[\p{L}\p{N},\-]$") & F.col("right").rlike(r"^\p{Ll}") & ~F.right("left", F.lit(60)).rlike(listing) & ~F.left("right", F.lit(60)).rlike(listing))
    one = layer.select("book_id", F.col("page_no"), F.right(squeeze(F.col("text")), F.lit(500)).alias("end"))
    two = layer.select("book_id", F.col("page_no").alias("next_no"), F.left(squeeze(F.col("text")), F.lit(400)).alias("begin"))
    j = b.join(one, ["book_id", "page_no"]).join(two, ["book_id", "next_no"])
    ok = F.contains("end", F.right(squeeze(F.col("left")), F.lit(40))) & F.contains("begin", F.left(squeeze(F.col("right")), F.lit(40)))
    return j.where(ok).select("book_id", "page_no", "next_no", F.when(F.col("left").endswith("-"), "").otherwise(" ").alias("sep"))
