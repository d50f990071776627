"""Pages of books: chunk plans, coverage, seams, and reconciliation.

A page relation has book_id, page_no (1-based, within the book) and text. A book may hold a third of all pages, so texts never
meet by book: pages are numbered in ranges of ids, neighbours find each other by an equal join of their numbers, and windows
over a book see plans, counts and flags only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions.text import ustrip

#: A page with this many characters on average has a text layer.
TEXT_LAYER_CHARS = 40
# The marker of a page in a paged source, as it is written and as it is found.
MARKER = "<!-- ===== 原书第 %d 页（%s）===== -->"
MARKED = r"<!-- ===== 原书第 (\d+) 页（([^）]*)）===== -->"
# Beginnings of a block, and ends of a sentence.
BLOCK_START = r"^\s*(#|【|例|图|表|注|解|分析|证明|题型|习题|第\s*\d+\s*[章节讲]|<!--)"
SENTENCE_ENDS = "。！？…；;!?：:"
#: Pages of a range in a page specification, at most.
SPEC_PAGES = 100_000


#: Pages of a range in which pages are numbered, if ids lie evenly; and the fewest ids of it.
RANGE_IDS = 4096


def book_pages(docs: DataFrame, *columns: Column) -> DataFrame:
    """(book_id, page_no, doc_id, and the columns; without columns: text): the documents of a source, by id, as the pages of a book.

    Columns are computed where a document is read, so what is shuffled are they, not the texts. Pages are ranked within ranges of
    ids, as wide as the ids are sparse; a range begins where the counts of those before it end. A window thus holds about
    RANGE_IDS pages of a source, whatever the source's size; only counts, one row a range, meet by source.
    """
    bounds = docs.agg(F.min("doc_id").alias("__least"), F.greatest(F.lit(RANGE_IDS), F.ceil((F.max("doc_id") - F.min("doc_id") + 1) * RANGE_IDS / F.count("*"))).alias("__width"))
    range_ = F.floor((F.col("doc_id") - F.col("__least")) / F.col("__width"))
    # bounds is one row.
    rows = docs.select(F.col("source").alias("book_id"), "doc_id", *(columns or ("text",))).crossJoin(F.broadcast(bounds)).withColumn("__range", range_).drop("__least", "__width")
    before = Window.partitionBy("book_id").orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    sizes = rows.groupBy("book_id", "__range").agg(F.count("*").alias("n"))
    starts = sizes.select(F.col("book_id").alias("__of"), F.col("__range").alias("__at"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__start"))
    nth = F.row_number().over(Window.partitionBy("book_id", "__range").orderBy("doc_id"))
    placed = rows.withColumn("__nth", nth).join(starts, F.col("book_id").eqNullSafe(F.col("__of")) & F.col("__range").eqNullSafe(F.col("__at")))
    return placed.withColumn("page_no", (F.col("__start") + F.col("__nth")).cast("int")).select("book_id", "page_no", *[c for c in rows.columns if c not in ("book_id", "__range")])


def books(pages: DataFrame) -> DataFrame:
    """(book_id, page_count, byte_size)."""
    return pages.groupBy("book_id").agg(F.count("*").cast("int").alias("page_count"), F.sum(F.octet_length("text")).alias("byte_size"))


def chunk_plan(books: DataFrame, max_pages: int = 20, max_bytes: int = 200_000_000, max_chunks: int = 50) -> DataFrame:
    """(book_id, chunk_id, page_start, page_end): equal runs of pages, 0-based and inclusive.

    As many chunks as pages or bytes ask for, but no more than max_chunks; chunks then grow instead.
    """
    parts = F.greatest(F.lit(1), F.ceil(F.col("page_count") / max_pages), F.ceil(F.col("byte_size") / max_bytes))
    per = F.ceil(F.col("page_count") / F.least(F.lit(max_chunks), parts)).cast("int")
    starts = F.sequence(F.lit(0), F.col("page_count") - 1, F.col("per"))
    planned = books.where("page_count > 0").withColumn("per", per).select("book_id", "page_count", "per", F.posexplode(starts).alias("i", "page_start"))
    return planned.select("book_id", F.format_string("c%03d", F.col("i") + 1).alias("chunk_id"), "page_start", F.least(F.col("page_count") - 1, F.col("page_start") + F.col("per") - 1).alias("page_end"))


def chunk_name(stem: Column) -> Column:
    """The file name of a chunk, with 1-based pages."""
    return F.format_string("%s.%s.p%04d-%04d.pdf", stem, F.col("chunk_id"), F.col("page_start") + 1, F.col("page_end") + 1)


def coverage_problems(ranges: DataFrame, counts: DataFrame) -> DataFrame:
    """(book_id, chunk_id, problem, at, expected): gaps and overlaps of neighbours, uncovered heads and tails.

    ranges: book_id, chunk_id, page_start, page_end; counts: book_id, page_count.
    """
    order = Window.partitionBy("book_id").orderBy("page_start", "chunk_id")
    r = ranges.withColumn("want", F.coalesce(F.lag("page_end").over(order) + 1, F.lit(0))).withColumn("last", F.lead("page_start").over(order).isNull())
    r = r.join(counts.select("book_id", "page_count"), "book_id")
    first = F.when(F.col("page_start") > F.col("want"), "gap").when(F.col("page_start") < F.col("want"), "overlap")
    tail = F.when(F.col("last") & (F.col("page_end") < F.col("page_count") - 1), "tail")
    found = F.array(F.struct(first.alias("problem"), F.col("page_start").alias("at"), F.col("want").alias("expected")), F.struct(tail.alias("problem"), F.col("page_end").alias("at"), (F.col("page_count") - 1).alias("expected")))
    return r.select("book_id", "chunk_id", F.explode(found).alias("f")).select("book_id", "chunk_id", "f.*").where("problem is not null")


def with_chunk(pages: DataFrame, chunks: DataFrame) -> DataFrame:
    """pages with the chunk that holds each: an as-of join on the greatest start not after the page.

    Chunk starts are merged into the pages' order and carried forward, so the cost is a sort of each book, whatever
    the chunks' lengths.
    """
    starts = chunks.select("book_id", (F.col("page_start") + 1).alias("page_no"), F.lit(0).alias("kind"), F.col("chunk_id").alias("start_chunk"), F.lit(None).cast("bigint").alias("doc_id"))
    rows = pages.select("book_id", "page_no", F.lit(1).alias("kind"), F.lit(None).cast("string").alias("start_chunk"), "doc_id").unionByName(starts)
    order = Window.partitionBy("book_id").orderBy("page_no", "kind").rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("chunk_id", F.last("start_chunk", ignorenulls=True).over(order)).where("kind = 1").select("book_id", "page_no", "doc_id", "chunk_id")


def paged_pieces(pages: DataFrame) -> DataFrame:
    """(book_id, page_no, piece) of pages (book_id, page_no, chunk_id, text): each page behind its marker. A book's pieces in their
    order, joined by line breaks, are its paged source; they are rows, since a book may be long."""
    mark = F.format_string(MARKER, "page_no", "chunk_id")
    return pages.select("book_id", "page_no", F.concat(mark, F.lit("\n\n"), ustrip(F.coalesce("text", F.lit(""))), F.lit("\n")).alias("piece"))


def pages_of_markdown(sources: DataFrame) -> DataFrame:
    """(book_id, page_no, chunk_id, text) of paged sources (book_id, markdown): what stands between two page markers."""
    numbers = F.regexp_extract_all("markdown", F.lit(MARKED), F.lit(1))
    chunks = F.regexp_extract_all("markdown", F.lit(MARKED), F.lit(2))
    texts = F.transform(F.slice(F.split("markdown", MARKED), 2, 2_000_000_000), lambda t: F.regexp_replace(t, r"^\n+|\n+$", ""))
    zipped = F.arrays_zip(numbers.alias("n"), chunks.alias("c"), texts.alias("t"))
    return sources.select("book_id", F.explode(zipped).alias("p")).select("book_id", F.col("p.n").cast("int").alias("page_no"), F.col("p.c").alias("chunk_id"), F.col("p.t").alias("text"))


def fixed_split(counts: DataFrame, size: int) -> DataFrame:
    """(book_id, page_start, page_end), 1-based: books (book_id, page_count) in parts of size pages."""
    parts = counts.where("page_count > 0").select("book_id", "page_count", F.explode(F.sequence(F.lit(1), F.col("page_count"), F.lit(size))).alias("page_start"))
    return parts.select("book_id", "page_start", F.least(F.col("page_count"), F.col("page_start") + size - 1).alias("page_end"))


def pending(chunks: DataFrame, extracted: DataFrame) -> DataFrame:
    """The chunks without a result (book_id, chunk_id)."""
    return chunks.join(extracted.select("book_id", "chunk_id"), ["book_id", "chunk_id"], "left_anti")


def seam_texts(seams: DataFrame, pages: DataFrame, size: int = 160) -> DataFrame:
    """Seams with the end of the left page, the beginning of the right one and how they look together: block (the right page
    begins a block), sentence (the left one ends a sentence) or suspicious. seams: book_id, left_page, right_page; pages:
    book_id, page_no, text. Pages find their seam by an equal join; of texts, size characters go along."""
    flat = F.regexp_replace(ustrip(F.coalesce("text", F.lit(""))), r"\s+", " ")
    left = pages.select("book_id", F.col("page_no").alias("left_page"), F.right(flat, F.lit(size)).alias("tail"))
    right = pages.select("book_id", F.col("page_no").alias("right_page"), F.left(flat, F.lit(size)).alias("head"))
    j = seams.join(left, ["book_id", "left_page"], "left").join(right, ["book_id", "right_page"], "left")
    tail, head = F.coalesce("tail", F.lit("")), F.coalesce("head", F.lit(""))
    look = F.when(head.rlike(BLOCK_START), "block").when((tail != "") & F.lit(SENTENCE_ENDS).contains(F.right(tail, F.lit(1))), "sentence").otherwise("suspicious")
    return j.withColumns({"tail": tail, "head": head}).withColumn("look", look)


def work_pages(low: DataFrame, seams: DataFrame, counts: DataFrame, around: int = 1) -> DataFrame:
    """(book_id, page_no, is_seam): the pages to look at: low ones with their neighbours, and both pages of every seam."""
    at = seams.select("book_id", F.explode(F.array("left_page", "right_page")).alias("page_no"), F.lit(True).alias("is_seam")).where("page_no is not null")
    near = context_pages(low, counts, around).withColumn("is_seam", F.lit(False))
    return near.unionByName(at).groupBy("book_id", "page_no").agg(F.max("is_seam").alias("is_seam"))


def seams(chunks: DataFrame, chars: DataFrame) -> DataFrame:
    """(book_id, left_chunk, right_chunk, left_page, right_page, left_chars, right_chars, verdict) of neighbouring chunks.

    chars: book_id, page_no, chars. A page that is missing there is unknown, not empty.
    """
    order = Window.partitionBy("book_id").orderBy("page_start")
    s = chunks.withColumn("right_chunk", F.lead("chunk_id").over(order)).withColumn("right_page", F.lead("page_start").over(order) + 1).where("right_chunk is not null")
    s = s.select("book_id", F.col("chunk_id").alias("left_chunk"), "right_chunk", (F.col("page_end") + 1).alias("left_page"), "right_page")
    left = chars.select("book_id", F.col("page_no").alias("left_page"), F.col("chars").alias("left_chars"))
    right = chars.select("book_id", F.col("page_no").alias("right_page"), F.col("chars").alias("right_chars"))
    s = s.join(left, ["book_id", "left_page"], "left").join(right, ["book_id", "right_page"], "left")
    verdict = F.when(F.col("left_chars").isNull() | F.col("right_chars").isNull(), "unknown").when((F.col("left_chars") == 0) | (F.col("right_chars") == 0), "empty").otherwise("ok")
    return s.withColumn("verdict", verdict)


def reconciled(chunks: DataFrame, parsed: DataFrame) -> DataFrame:
    """Chunks with expected_pages, parsed_pages and status (missing, short, extra, ok). parsed: book_id, chunk_id, parsed_pages."""
    expected = chunks.select("book_id", "chunk_id", (F.col("page_end") - F.col("page_start") + 1).alias("expected_pages"))
    r = expected.join(parsed, ["book_id", "chunk_id"], "left")
    p, e = F.col("parsed_pages"), F.col("expected_pages")
    return r.withColumn("status", F.when(p.isNull(), "missing").when(p < e, "short").when(p > e, "extra").otherwise("ok"))


def page_chars(entries: DataFrame) -> DataFrame:
    """(book_id, page_no, chars): stripped lengths summed over a page's entries; entries: book_id, page_no, text."""
    return page_chars_of(entries.select("book_id", "page_no", text_chars(F.col("text")).alias("chars")))


def page_chars_of(entries: DataFrame) -> DataFrame:
    """page_chars, of entries (book_id, page_no, chars)."""
    return entries.groupBy("book_id", "page_no").agg(F.sum("chars").alias("chars"))


def context_pages(low: DataFrame, counts: DataFrame, around: int = 1) -> DataFrame:
    """Distinct (book_id, page_no) of low pages and their neighbours, inside the book."""
    near = low.select("book_id", F.explode(F.sequence(F.col("page_no") - around, F.col("page_no") + around)).alias("page_no"))
    return near.join(counts, "book_id").where("page_no between 1 and page_count").select("book_id", "page_no").distinct()


def uncovered_pages(counts: DataFrame, ranges: DataFrame) -> DataFrame:
    """(book_id, page_no) of pages that no range (1-based, inclusive) has."""
    every = counts.where("page_count > 0").select("book_id", F.explode(F.sequence(F.lit(1), F.col("page_count"))).alias("page_no"))
    got = ranges.where("page_start <= page_end").select("book_id", F.explode(F.sequence("page_start", "page_end")).alias("page_no"))
    return every.join(got, ["book_id", "page_no"], "left_anti")


def page_spec(spec: Column) -> Column:
    """An array of the distinct pages, sorted, of lists like "3, 5-7 9"; parts that aren't numbers above 0 are left out.

    A range of more than SPEC_PAGES pages is an error, since no book has so many.
    """
    parts = F.filter(F.split(spec, r"[\s,，]+"), lambda p: p.rlike(r"^\d{1,9}(-\d{1,9})?$"))
    one = lambda p: F.split_part(p, F.lit("-"), F.lit(1)).cast("int")
    to = lambda p: F.element_at(F.split(p, "-"), -1).cast("int")
    pages = F.flatten(F.transform(parts, lambda p: F.when(to(p) - one(p) >= SPEC_PAGES, F.raise_error(F.concat(F.lit("too many pages: "), p)).cast("array<int>")).when(one(p) <= to(p), F.sequence(one(p), to(p))).otherwise(F.array().cast("array<int>"))))
    return F.array_sort(F.array_distinct(F.filter(pages, lambda x: x > 0)))


def text_layer(pages: DataFrame, sample: int = 12) -> DataFrame:
    """(book_id, sampled_pages, chars_per_page, has_text_layer) from at most sample pages, the middle and the last.

    The sample is a feature: it decides from a few pages whether a book is scanned. pages: book_id, page_no, chars (of the
    stripped text). Counts of the books, one row each, are joined back; pages aren't shuffled by book.
    """
    counts = pages.groupBy("book_id").agg(F.count("*").alias("n")).withColumnRenamed("book_id", "__book")
    p = pages.join(counts, F.col("book_id").eqNullSafe(F.col("__book"))).withColumn("i", F.col("page_no") - 1)
    step = F.greatest(F.lit(1), F.floor(F.col("n") / sample)).cast("int")
    taken = (F.col("n") <= sample) | ((F.col("i") % step == 0) & (F.col("i") < sample * step)) | (F.col("i") == F.floor(F.col("n") / 2)) | (F.col("i") == F.col("n") - 1)
    got = p.where(taken).groupBy("book_id").agg(F.count("*").alias("sampled_pages"), F.sum("chars").alias("chars"))
    return got.select("book_id", "sampled_pages", F.round(F.col("chars") / F.col("sampled_pages"), 6).alias("chars_per_page"), (F.col("chars") >= TEXT_LAYER_CHARS * F.col("sampled_pages")).alias("has_text_layer"))


def text_chars(text: Column) -> Column:
    """The length of a page's stripped text, 0 if it has none."""
    return F.coalesce(F.length(ustrip(text)), F.lit(0))


def well_formed_seams(audits: DataFrame) -> DataFrame:
    """(book_id, idx, left_page, right_page) of the seams in audits (book_id, value), JSON; entries that are no objects, and
    audits without seams, give no rows."""
    entries = F.try_variant_get(F.try_parse_json("value"), "$.seams", "array<variant>")
    e = audits.select("book_id", F.explode(entries).alias("e")).where(F.schema_of_variant("e").startswith("OBJECT"))
    field = lambda k: F.try_variant_get("e", f"$.{k}", "int")
    return e.select("book_id", field("index").alias("idx"), field("left_page").alias("left_page"), field("right_page").alias("right_page"))


def bundle_order(found: DataFrame, planned: DataFrame) -> DataFrame:
    """(book_id, bundle, pos) of found bundles (book_id, bundle): in the order of the book's plan (book_id, chunk_id, page_start)
    if it has one, bundles out of it left out; else by name."""
    p = planned.select("book_id", F.col("chunk_id").alias("bundle"), "page_start")
    has = planned.select("book_id").distinct().withColumn("planned", F.lit(True))
    j = found.join(p, ["book_id", "bundle"], "left").join(has, "book_id", "left").where("planned is null or page_start is not null")
    order = Window.partitionBy("book_id").orderBy(F.asc_nulls_first("page_start"), "bundle")
    return j.select("book_id", "bundle", F.row_number().over(order).alias("pos"))
