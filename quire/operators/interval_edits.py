"""Edits of books as intervals: every edit finds its places in the original text, on the pages, and becomes (start, stop, insert).

A book is a relation of pages (book_id, page_no, text) and may be of any size: pages aren't put together. A plan is a
relation of edits: book_id, seq, op, find, with_, expect, occurrence, right_head. Places are counted over the whole book;
intervals that overlap are a conflict, found between neighbours in one window over a page's intervals; a page's new text is put together from
the pieces between its intervals. All edits of a book hold or none does. Places and intervals are stored, since several steps read them.

Ops: append (text after an anchor that occurs once), join (no break between such an anchor and what follows it, also on the next page, which
must begin with the first 40 characters of right_head; a hyphen at the anchor's end goes), replace (a text that occurs expect times, once by
default), regex (all matches of a Java pattern within a page, expect of them if given; $1 are groups), drop_paragraph (the occurrence-th one, the second by
default, with the line breaks around it).

An edit is skipped if it is done already: the first line of an appended text is there, a replaced text isn't but its replacement
is, a pattern matches nothing, or an anchor is followed by right_head at once. Null texts count as empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.storage import stored

EDIT = ("seq", "op", "find", "with_", "expect", "occurrence", "right_head")
BREAKS = r"[\r\n]"


def _pattern() -> Column:
    quoted = F.concat(F.lit("\\Q"), F.replace("find", F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E"))
    return F.when(F.col("op") == "regex", F.col("find")).otherwise(quoted)


def places(pages: DataFrame, plan: DataFrame) -> DataFrame:
    """(book_id, seq, page_no, nth, start, stop, found) of each edit's places, start from 0 on its page, nth over the book from 1."""
    p = pages.select("book_id", "page_no", F.coalesce("text", F.lit("")).alias("text"))
    e = plan.select("book_id", "seq", "op", "find", _pattern().alias("pattern"))
    here = F.when(F.col("op") == "regex", F.rlike("text", F.col("pattern"))).otherwise(F.contains("text", "find"))
    j = p.join(e, "book_id").where((F.length("find") > 0) & here)
    j = j.withColumn("found", F.regexp_extract_all("text", F.col("pattern"), F.lit(0))).withColumn("gaps", F.split("text", F.col("pattern"), -1))
    chars = lambda parts, n: F.length(F.array_join(F.slice(parts, F.lit(1), n), ""))
    start = lambda x, i: F.struct((chars(F.col("gaps"), i + 1) + chars(F.col("found"), i)).alias("start"), x.alias("found"))
    at = j.select("book_id", "seq", "page_no", F.explode(F.transform("found", start)).alias("x")).select("book_id", "seq", "page_no", "x.*")
    nth = F.row_number().over(Window.partitionBy("book_id", "seq").orderBy("page_no", "start"))
    return at.where(F.length("found") > 0).select("book_id", "seq", "page_no", nth.alias("nth"), "start", (F.col("start") + F.length("found")).alias("stop"), "found")


def _present(pages: DataFrame, plan: DataFrame) -> DataFrame:
    """(book_id, seq, present) of the edits whose result is in the book already, as far as its text tells."""
    needle = F.when(F.col("op") == "append", F.split_part("with_", F.lit("\n"), F.lit(1))).when(F.col("op") == "replace", F.col("with_"))
    e = plan.select("book_id", "seq", needle.alias("needle")).where(F.length("needle") > 0)
    return pages.select("book_id", "text").join(e, "book_id").where(F.contains("text", "needle")).select("book_id", "seq").distinct().withColumn("present", F.lit(True))


def intervals(pages: DataFrame, plan: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The edits' outcomes (book_id, seq, status) and their intervals (book_id, seq, page_no, start, stop, insert, glued).

    status: done, skipped, or why an edit is refused. glued: the page goes on where the one before ends.
    """
    plan = plan.select("book_id", *EDIT)
    found = stored(places(pages, plan), "places")
    counts = found.groupBy("book_id", "seq").agg(F.count("*").alias("n"))
    edits = plan.join(counts, ["book_id", "seq"], "left").join(_present(pages, plan), ["book_id", "seq"], "left")
    edits = edits.withColumn("n", F.coalesce("n", F.lit(0))).withColumn("present", F.coalesce("present", F.lit(False))).withColumn("with_", F.coalesce("with_", F.lit("")))
    wanted = F.coalesce("expect", F.when(F.col("op") == "replace", 1))
    nth = F.coalesce("occurrence", F.lit(2))

    at = found.join(edits, ["book_id", "seq"])
    used = F.when(F.col("op").isin("append", "join"), (F.col("n") == 1) & ~((F.col("op") == "append") & F.col("present"))).when(F.col("op") == "drop_paragraph", F.col("nth") == nth).otherwise(wanted.isNull() | (F.col("n") == wanted))
    at = at.where(used)
    text = pages.select("book_id", "page_no", F.coalesce("text", F.lit("")).alias("text"))
    after = text.select("book_id", (F.col("page_no") - 1).alias("page_no"), F.col("text").alias("next_text"))
    at = at.join(text, ["book_id", "page_no"]).join(after, ["book_id", "page_no"], "left")
    rest, before = F.substr("text", F.col("stop") + 1), F.left("text", F.col("start"))
    blank = lambda c: F.length(F.regexp_extract(c, r"^\s*", 0))
    at = at.withColumn("room", blank(rest)).withColumn("over", (F.col("op") == "join") & (F.col("room") == F.length(rest))).withColumn("next_room", blank(F.coalesce("next_text", F.lit(""))))
    follows = F.when(F.col("over"), F.substr("next_text", F.col("next_room") + 1)).otherwise(F.substr("text", F.col("stop") + F.col("room") + 1))
    fits = F.startswith(F.coalesce(follows, F.lit("")), F.coalesce(F.left("right_head", F.lit(40)), F.lit("")))
    at = stored(at.withColumn("joins", F.when((F.col("room") == 0) & ~F.col("over"), "skipped").when(fits, "done").otherwise("other text follows")), "edits")
    hyphen = F.when(F.endswith("find", F.lit("-")), 1).otherwise(0)
    # An empty with_ of a hyphen's join stays empty; any other join has a blank.
    sep = F.when((hyphen == 0) & (F.col("with_") == ""), " ").otherwise(F.col("with_"))
    lead = lambda c, p: F.length(F.regexp_extract(c, p, 0))
    op = F.col("op")
    start = F.when(op == "append", F.col("stop")).when(op == "join", F.col("stop") - hyphen).when(op == "drop_paragraph", F.col("start") - lead(before, BREAKS + r"+$")).otherwise(F.col("start"))
    stop = F.when(op == "join", F.col("stop") + F.col("room")).when(op == "drop_paragraph", F.col("stop") + lead(rest, "^" + BREAKS + "+")).otherwise(F.col("stop"))
    insert = F.when(op == "append", F.concat(F.lit("\n\n"), "with_")).when(op == "join", sep).when(op == "drop_paragraph", F.lit("\n\n")).when(op == "regex", F.regexp_replace("found", F.col("find"), F.col("with_"))).otherwise(F.col("with_"))
    own = at.where((op != "join") | (F.col("joins") == "done"))
    made = own.select("book_id", "seq", "page_no", start.alias("start"), stop.alias("stop"), insert.alias("insert"), F.lit(False).alias("glued"))
    made = made.unionByName(own.where("over").select("book_id", "seq", (F.col("page_no") + 1).alias("page_no"), F.lit(0).alias("start"), F.col("next_room").alias("stop"), F.lit("").alias("insert"), F.lit(True).alias("glued")))

    order = Window.partitionBy("book_id", "page_no").orderBy("start", "stop", "seq")
    reached = F.max(F.struct("stop", "seq")).over(order.rowsBetween(Window.unboundedPreceding, -1))
    clash = made.withColumn("r", reached).where((F.col("r.stop") > F.col("start")) & (F.col("r.seq") != F.col("seq"))).select("book_id", "seq").distinct().withColumn("clash", F.lit(True))

    joins = at.where(op == "join").select("book_id", "seq", "joins")
    times = F.concat(F.lit("found "), F.col("n"), F.lit(" times"))
    none = F.col("n") == 0
    status = (
        F.when(F.coalesce("clash", F.lit(False)), "overlaps another edit")
        .when(op == "append", F.when(F.col("present"), "skipped").when(F.col("n") == 1, "done").otherwise(times))
        .when(op == "join", F.when(F.col("n") != 1, times).otherwise(F.col("joins")))
        .when(op == "regex", F.when(none, "skipped").when(wanted.isNull() | (F.col("n") == wanted), "done").otherwise(times))
        .when(op == "replace", F.when(none & F.col("present"), "skipped").when(F.col("n") == wanted, "done").otherwise(times))
        .when(op == "drop_paragraph", F.when(none, "skipped").when(F.col("n") >= nth, "done").otherwise(times))
        .otherwise("unknown op")
    )
    outcomes = edits.join(clash, ["book_id", "seq"], "left").join(joins, ["book_id", "seq"], "left").select("book_id", "seq", status.alias("status"))
    return outcomes, made


def edited(pages: DataFrame, plan: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The outcomes (book_id, seq, status), and all pages (book_id, page_no, text, changed, glued) with the edits of the books none of whose edits is refused.

    Pages without an interval are passed on as they are.
    """
    outcomes, made = intervals(pages, plan)
    outcomes, made = stored(outcomes, "outcomes"), stored(made, "intervals")
    refused = outcomes.where(~F.col("status").isin("done", "skipped")).select("book_id").distinct()
    kept = made.join(refused, "book_id", "left_anti").groupBy("book_id", "page_no").agg(F.array_sort(F.collect_list(F.struct("start", "stop", "insert"))).alias("cuts"), F.max("glued").alias("glued"))
    j = pages.select("book_id", "page_no", F.coalesce("text", F.lit("")).alias("text")).join(kept, ["book_id", "page_no"], "left")
    begin = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    piece = lambda a, x: F.struct(x["stop"].alias("at"), F.concat(a["out"], F.substr(F.col("text"), a["at"] + 1, x["start"] - a["at"]), x["insert"]).alias("out"))
    new = F.aggregate("cuts", begin, piece, lambda a: F.concat(a["out"], F.substr(F.col("text"), a["at"] + 1)))
    return outcomes, j.select("book_id", "page_no", F.coalesce(new, "text").alias("text"), F.col("cuts").isNotNull().alias("changed"), F.coalesce("glued", F.lit(False)).alias("glued"))


def whole_texts(pages: DataFrame) -> DataFrame:
    """(book_id, text) of edited pages: a line break between pages, none before a glued one. For books that fit one row."""
    lead = F.when(F.col("glued"), "").otherwise("\n")
    rows = pages.groupBy("book_id").agg(F.array_sort(F.collect_list(F.struct("page_no", F.concat(lead, "text").alias("piece")))).alias("p"))
    return rows.select("book_id", F.substr(F.array_join(F.transform("p", lambda x: x["piece"]), ""), F.lit(2)).alias("text"))


def joins_of(breaks: DataFrame, pages: DataFrame) -> DataFrame:
    """A plan of joins for page breaks (book_id, page_no, left_tail, right_head): those whose left end occurs once in its book.

    page_no is the left page's. A left end with a hyphen is joined without a blank.
    """
    seq = F.col("page_no").alias("seq")
    plan = breaks.select("book_id", seq, F.lit("join").alias("op"), F.col("left_tail").alias("find"), F.lit("").alias("with_"), F.lit(None).cast("int").alias("expect"), F.lit(None).cast("int").alias("occurrence"), "right_head")
    once = places(pages, plan).groupBy("book_id", "seq").agg(F.count("*").alias("n")).where("n = 1").select("book_id", "seq")
    return plan.join(once, ["book_id", "seq"], "left_semi")
