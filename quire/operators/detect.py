"""Detectors of anomalies in the text of pages. Each gives rows of one findings schema, so they can be unioned.

findings(detector, book_id, page_no, n, evidence). Detectors on single pages are maps over the pages; those on neighbours
are an equal join of what they need of a page and of the next one. findings_of reads each text once.
"""

from __future__ import annotations

import os

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions.text import lines, paragraphs, plain, strip_math, ustrip
from quire.operators.pages import book_pages
from quire.shipping import ship
from quire.storage import stored

# Endings of a sentence or block, and beginnings of a new block.
SENTENCE_END = "。！？；：…”』」》.!?;:"
NO_BREAK_TAIL = r"[。！？；：…”』」》.!?;:$）】，、]$"
BLOCK_START = r"^\s*(#|【|例|图|表|注|解|分析|证明|题型|习题|第\s*\d+\s*[章节讲]|<!--)"
NO_BREAK_HEAD = r"^[#*\-0-9A-D（(]"
#: Patterns that are one finding for each match.
PATTERNS = {
    "double_amp": "&amp;&amp;",
    "broken_glyph": r"[\x{25a1}\x{fffd}]",
    "isolated_o": r"[\x{4e00}-\x{9fff}]\s+o\s+[\x{4e00}-\x{9fff}]",
}
#: Fixed value: LaTeX that stands outside math.
BARE_LATEX = r"(?<!\\)\\[a-zA-Z]{2,}|(?:[0-9A-Za-z\)\]])[_^]\{"
# What stands before and after a number that is no page stamp.
NO_STAMP_BEFORE = "第共约近超达至了于和与及等该这此其每余前后左右年月日时分秒版次章节点页个条件项类种代期层位名分数值比中上下不的之与图表格有為为是在要需能可占到从由多小大"
NO_STAMP_AFTER = ["美元", "元", "瓦", "天", "倍", "个", "种", "世纪", "年", "月", "日", "字节", "位", "行", "列", "块", "级", "条", "页", "秒", "小时", "分钟", "纳秒", "毫秒", "微秒", "纳米", "平方", "次", "项", "GHz", "MHz", "Hz", "KB", "MB", "GB", "TB", "nm", "bit", "ms", "ns", "cm", "mm", "%", "％", "℃"]
STAMP = r"([\x{4e00}-\x{9fff}。，、；：？！）】”])(?<!\d)(\d{1,3})(?=([\x{4e00}-\x{9fff}（【“].?))"


def findings(df: DataFrame, detector: str, n: Column, evidence: Column) -> DataFrame:
    return df.select(F.lit(detector).alias("detector"), "book_id", "page_no", n.cast("long").alias("n"), evidence.alias("evidence"))


def pattern_counts(pages: DataFrame, patterns: dict[str, str] = PATTERNS) -> DataFrame:
    """A finding for each page and pattern that matches: how often, and the first match."""
    one = F.explode(F.array(*[F.struct(F.lit(k).alias("detector"), F.regexp_count("text", F.lit(p)).cast("long").alias("n"), F.regexp_extract("text", p, 0).alias("evidence")) for k, p in patterns.items()]))
    return pages.select("book_id", "page_no", one.alias("f")).where("f.n > 0").select("f.detector", "book_id", "page_no", "f.n", "f.evidence")


def keyword_hits(pages: DataFrame, keywords: list[str]) -> DataFrame:
    """(book_id, page_no, keyword, n) for keyword patterns, which are configuration."""
    one = F.explode(F.array(*[F.struct(F.lit(k).alias("keyword"), F.regexp_count("text", F.lit(k)).cast("long").alias("n")) for k in keywords]))
    return pages.select("book_id", "page_no", one.alias("f")).select("book_id", "page_no", "f.*").where("n > 0")


def bare_latex(pages: DataFrame) -> DataFrame:
    hits = F.regexp_extract_all(strip_math(F.col("text")), F.lit(BARE_LATEX), F.lit(0))
    return findings(pages.withColumn("hits", hits).where(F.size("hits") > 0), "bare_latex", F.size("hits"), F.col("hits")[0])


def page_stamps(text: Column) -> Column:
    """The numbers in a text that look like printed page numbers read into a sentence."""
    before = F.regexp_extract_all(text, F.lit(STAMP), F.lit(1))
    number = F.regexp_extract_all(text, F.lit(STAMP), F.lit(2))
    after = F.regexp_extract_all(text, F.lit(STAMP), F.lit(3))
    units = [lambda x, u=u: x["after"].startswith(u) for u in NO_STAMP_AFTER if len(u) <= 2 and ord(u[0]) > 127]

    def stamp(x: Column) -> Column:
        unit = F.lit(False)
        for u in units:
            unit = unit | u(x)
        return ~F.lit(NO_STAMP_BEFORE).contains(x["before"]) & ~unit & ~x["number"].rlike("^0..$")

    zipped = F.arrays_zip(before.alias("before"), number.alias("number"), after.alias("after"))
    return F.transform(F.filter(zipped, stamp), lambda x: x["number"].cast("int"))


def short_pages(pages: DataFrame) -> DataFrame:
    """Empty pages, and pages under the greater of 60 characters and 15 % of the book's median page.

    The median is the upper one: the middle value, or the higher of the two. It comes from counts of the book's sizes.
    """
    return short_of(pages.select("book_id", "page_no", page_size(F.col("text")).alias("size")))


def page_size(text: Column) -> Column:
    return F.length(ustrip(F.coalesce(text, F.lit(""))))


def short_of(sized: DataFrame) -> DataFrame:
    """short_pages, of pages (book_id, page_no, size)."""
    by = Window.partitionBy("book_id")
    counts = sized.groupBy("book_id", "size").agg(F.count("*").alias("k")).withColumn("upto", F.sum("k").over(by.orderBy("size"))).withColumn("m", F.sum("k").over(by))
    median = counts.where("upto >= m div 2 + 1 and upto - k < m div 2 + 1").select("book_id", F.col("size").alias("median"))
    out = sized.join(median, "book_id").where("size < greatest(60, 0.15 * median)")
    return out.select(F.when(F.col("size") == 0, "empty_page").otherwise("short_page").alias("detector"), "book_id", "page_no", F.col("size").cast("long").alias("n"), F.col("median").cast("string").alias("evidence"))


def repeated_paragraphs(pages: DataFrame, least: int = 40) -> DataFrame:
    """(paragraph, n, first_page, last_page) of paragraphs that occur at least twice, pages as doc_id.

    A group's pages aren't collected, since a paragraph may be on a third of all pages; paragraph_pages gives them as rows.
    """
    return _repeated(paragraph_pages(pages, least), "paragraph")


def _repeated(rows: DataFrame, what: str) -> DataFrame:
    """Texts are counted by their digests; the text itself is one of a partition's, so it is shuffled once for each of these."""
    counted = rows.groupBy(F.sha2(what, 256).alias("digest")).agg(F.first(what).alias(what), F.count("*").alias("n"), F.min("doc_id").alias("first_page"), F.max("doc_id").alias("last_page"))
    return counted.where("n >= 2").drop("digest")


def paragraph_pages(pages: DataFrame, least: int = 40) -> DataFrame:
    p = pages.select("doc_id", F.explode(paragraphs(F.col("text"))).alias("paragraph"))
    return p.where((F.length("paragraph") >= least) & ~F.col("paragraph").rlike(r"^(<div|<!--|\|)"))


def repeated_lines(pages: DataFrame, least: int = 40) -> DataFrame:
    """The same for lines."""
    p = pages.select("doc_id", F.explode(lines(F.col("text"))).alias("line")).withColumn("line", ustrip(F.col("line"))).where(F.length("line") >= least)
    return _repeated(p, "line")


def neighbours(pages: DataFrame, *columns: str) -> DataFrame:
    """Pages with the given columns of the next page, as next_<column>: the page of the same book with the next number."""
    after = pages.select(F.col("book_id").alias("__book"), (F.col("page_no") - 1).alias("__no"), *[F.col(c).alias(f"next_{c}") for c in columns])
    return pages.join(after, F.col("book_id").eqNullSafe(F.col("__book")) & (F.col("page_no") == F.col("__no"))).drop("__book", "__no")


def same_heads(pages: DataFrame, size: int = 80) -> DataFrame:
    """Neighbouring pages that begin with the same characters."""
    return same_heads_of(pages.select("book_id", "page_no", page_head(F.col("text"), size).alias("head")))


def same_heads_of(pages: DataFrame) -> DataFrame:
    """same_heads, of pages (book_id, page_no, head)."""
    return _same(neighbours(pages.select("book_id", "page_no", "head").where("head is not null"), "head"))


def page_head(text: Column, size: int = 80) -> Column:
    """The stripped text's beginning, null if it is shorter."""
    cut = F.left(ustrip(text), F.lit(size))
    return F.when(F.length(cut) == size, cut)


def _same(n: DataFrame) -> DataFrame:
    return findings(n.where("head = next_head"), "same_head", F.lit(1), F.col("head"))


def heads(pages: DataFrame, size: int = 80) -> DataFrame:
    """(head, n, first_page) of beginnings that several pages share, next to each other or not."""
    cut = pages.select("doc_id", F.left(ustrip(F.col("text")), F.lit(size)).alias("head")).where(F.length("head") == size)
    return cut.groupBy("head").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_page")).where("n >= 2")


def page_breaks(pages: DataFrame) -> DataFrame:
    """Pages whose last sentence seems to go on on the next page: the end is no sentence's, the beginning no block's."""
    return breaks_of(pages.select("book_id", "page_no", *page_ends(F.col("text"))))


def breaks_of(ends: DataFrame) -> DataFrame:
    """page_breaks, of pages (book_id, page_no, first, last) that were cut down to their ends."""
    return _breaks(neighbours(ends, "first"))


def page_ends(text: Column) -> list[Column]:
    """first: a page's beginning, null if it can't go on from another page; last: its end, null if it can't go on."""
    t = ustrip(text)
    first = F.when((t != "") & ~t.rlike(BLOCK_START) & ~t.rlike(NO_BREAK_HEAD), F.left(t, F.lit(18)))
    return [first.alias("first"), F.when((t != "") & ~t.rlike(NO_BREAK_TAIL), F.right(t, F.lit(18))).alias("last")]


def _breaks(n: DataFrame) -> DataFrame:
    hit = n.where("last is not null and next_first is not null")
    return findings(hit, "page_break", F.col("page_no") + 1, F.concat("last", F.lit(" | "), "next_first"))


def odd_dollars(pages: DataFrame) -> DataFrame:
    """(doc_id, line_no, dollars): lines with an odd number of dollar signs."""
    at = pages.select("doc_id", F.posexplode(lines(F.col("text"))).alias("i", "line")).withColumn("line", ustrip(F.col("line")))
    at = at.withColumn("dollars", F.regexp_count("line", F.lit(r"\$")).cast("long"))
    return at.where("dollars % 2 = 1").where(~F.col("line").startswith("<!--")).select("doc_id", (F.col("i") + 1).alias("line_no"), "dollars")


def longest_run(a: str, b: str, piece: int) -> tuple[int, int, int]:
    """(i, j, n): the longest run a[i:i+n] == b[j:j+n] that holds a whole piece of a, cut at multiples of its size, the first in a, then
    the first in b: every run of twice the size holds one. Pieces are looked up in b and drawn out, each diagonal once."""

    def same(i: int, j: int) -> int:
        """How many characters are the same from a[i] and b[j] on."""
        return len(os.path.commonprefix([a[i:], b[j:]]))

    best, reached = (0, 0, 0), {}
    for at in range(0, len(a) - piece + 1, piece):
        j = b.find(a[at : at + piece])
        while j >= 0:
            if reached.get(j - at, 0) <= at:
                back = len(os.path.commonprefix([a[:at][::-1], b[:j][::-1]]))
                n = back + same(at, j)
                reached[j - at] = at - back + n
                best = max(best, (at - back, j - back, n), key=lambda x: (x[2], -x[0], -x[1]))
            j = b.find(a[at : at + piece], j + 1)
    return best


def adjacent_overlaps(pages: DataFrame, least: int = 120) -> DataFrame:
    """Neighbouring pages that share a long run of text where they meet.

    A native test goes first: a common run of least characters holds a whole 60-character piece of the left end, cut at
    multiples of 60, so pairs without such a piece in the right page never reach the Python function.
    """
    ship(pages.sparkSession)
    cut = pages.select("book_id", "page_no", plain(F.coalesce("text", F.lit(""))).alias("text"))
    n = neighbours(cut.select("book_id", "page_no", F.right("text", F.lit(2000)).alias("a"), F.left("text", F.lit(4000)).alias("b")), "b")
    n = n.select("book_id", "page_no", "a", F.col("next_b").alias("b"))
    half = least // 2
    pieces = F.transform(F.sequence(F.lit(0), F.lit(2000 // half)), lambda i: F.substring("a", i * half + 1, F.lit(half)))
    n = n.where((F.length("a") >= least) & (F.length("b") >= least)).where(F.exists(pieces, lambda p: (F.length(p) == half) & F.contains("b", p)))

    @F.pandas_udf("size int, run string")
    def longest(a: pd.Series, b: pd.Series) -> pd.DataFrame:
        rows = []
        for x, y in zip(a, b, strict=True):
            i, _, size = longest_run(x, y, half)
            rows.append((size, x[i : i + size]))
        return pd.DataFrame(rows, columns=["size", "run"])

    # Behind a generator, the conditions on the run don't ask for it again.
    hit = n.withColumn("m", F.explode(F.array(longest("a", "b")))).where(F.col("m.size") >= least)
    hit = hit.where(F.regexp_count("m.run", F.lit(r"[\x{4e00}-\x{9fff}]")) + F.floor(F.length("m.run") / 2) >= 40)
    return findings(hit, "adjacent_overlap", F.col("m.size"), F.left("m.run", F.lit(60)))


def page_features(text: Column) -> list[Column]:
    """What all detectors need of a page, none of it as long as its text: its own findings, size, head and ends.

    Costly patterns are tried only where a page holds the characters they ask for.
    """
    one = lambda name, n, evidence: F.struct(F.lit(name).alias("detector"), n.cast("long").alias("n"), evidence.alias("evidence"))
    where = lambda test, found: F.when(test, found)
    latex = F.regexp_extract_all(strip_math(text), F.lit(BARE_LATEX), F.lit(0))
    odd = lambda x: (F.regexp_count(x, F.lit(r"\$")) % 2 == 1) & ~ustrip(x).startswith("<!--")
    single = F.array(
        *[where(text.rlike(p), one(k, F.regexp_count(text, F.lit(p)), F.regexp_extract(text, p, 0))) for k, p in PATTERNS.items()],
        where(text.contains("\\") | text.contains("{"), one("bare_latex", F.size(latex), F.get(latex, F.lit(0)))),
        where(text.contains("$"), one("odd_dollar", F.size(F.filter(lines(text), odd)), F.lit(""))),
    )
    return [F.filter(single, lambda x: x["n"] > 0).alias("single"), page_size(text).alias("size"), page_head(text).alias("head"), *page_ends(text)]


def all_findings(seen: DataFrame) -> DataFrame:
    """The union of the detectors. seen: book_id, page_no and page_features; stored, since it is used for each kind of detector."""
    n = neighbours(seen.select("book_id", "page_no", "head", "first", "last"), "head", "first")
    found = seen.select("book_id", "page_no", F.explode("single").alias("f")).select("f.detector", "book_id", "page_no", "f.n", "f.evidence")
    return found.unionByName(_same(n)).unionByName(_breaks(n)).unionByName(short_of(seen.select("book_id", "page_no", "size")))


def findings_of(docs: DataFrame) -> DataFrame:
    """All findings of documents (source, doc_id, text) as pages of books. Each text is read once, and shuffled nowhere."""
    return all_findings(stored(book_pages(docs, *page_features(F.col("text"))), "features"))
