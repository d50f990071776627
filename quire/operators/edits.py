"""Guarded edits of book texts: each edit says what it expects, is skipped if done already, and refuses to guess.

A plan is a relation of edits: book_id, seq, op, find, with_, expect, occurrence. Books are edited independently, one task each,
since an edit sees what the ones before it left; all edits of a book hold or none does.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions.text import occurrences
from quire.shipping import ship

#: append: text after a unique anchor; join: drop the break between a unique anchor and what follows; replace: exact text;
#: regex: all matches; drop_paragraph: the nth occurrence with the line breaks around it.
OPS = ("append", "join", "replace", "regex", "drop_paragraph")


def unique(text: Column, anchor: Column) -> Column:
    """Whether an anchor occurs exactly once."""
    return occurrences(text, anchor) == 1


def guarded_replace(docs: DataFrame, pattern: str, replacement: str, expect: int) -> DataFrame:
    """docs with hits, status and new_text: replaced only where the pattern matches expect times."""
    hits = F.regexp_count("text", F.lit(pattern))
    status = F.when(F.col("hits") == 0, "skipped").when(F.col("hits") == expect, "applied").otherwise("refused")
    return docs.withColumn("hits", hits).withColumn("status", status).withColumn("new_text", F.when(F.col("status") == "applied", F.regexp_replace("text", pattern, replacement)).otherwise(F.col("text")))


def apply_one(text: str, op: str, find: str, with_: str, expect: int | None, occurrence: int | None) -> tuple[str, str]:
    """The text after an edit, and done, skipped or why it was refused."""
    n = text.count(find) if op != "regex" else len(re.findall(find, text))
    if op == "append":
        if with_.split("\n", 1)[0] in text:
            return text, "skipped"
        return (text.replace(find, find + "\n\n" + with_), "done") if n == 1 else (text, f"anchor found {n} times")
    if op == "join":
        if n != 1:
            return text, f"anchor found {n} times"
        left, rest = text.split(find)
        if not rest[:1].isspace():
            return text, "skipped"
        hyphen = find.endswith("-")
        return left + (find[:-1] if hyphen else find) + (with_ if with_ or hyphen else " ") + rest.lstrip(), "done"
    if op == "regex":
        if not n:
            return text, "skipped"
        return (re.sub(find, with_, text), "done") if expect is None or n == expect else (text, f"matched {n} times, not {expect}")
    if op == "replace":
        if not n and with_ and with_ in text:
            return text, "skipped"
        return (text.replace(find, with_), "done") if n == (expect or 1) else (text, f"found {n} times, not {expect or 1}")
    at = [m.start() for m in re.finditer(re.escape(find), text)]
    nth = occurrence or 2
    if not at:
        return text, "skipped"
    if len(at) < nth:
        return text, f"found {len(at)} times, not {nth}"
    return text[: at[nth - 1]].rstrip("\r\n") + "\n\n" + text[at[nth - 1] + len(find) :].lstrip("\r\n"), "done"


def applied(books: DataFrame, plan: DataFrame) -> DataFrame:
    """(book_id, seq, status, text): the outcome of every edit; the row with seq -1 has the book's text, the old one if any edit was refused."""
    ship(books.sparkSession)

    def edit(book: pd.DataFrame, edits: pd.DataFrame) -> pd.DataFrame:
        rows = []
        for b in book.itertuples(index=False):
            text, bad = b.text or "", False
            for e in edits.sort_values("seq").itertuples(index=False):
                expect = None if pd.isna(e.expect) else int(e.expect)
                occurrence = None if pd.isna(e.occurrence) else int(e.occurrence)
                text, status = apply_one(text, e.op, e.find, e.with_ or "", expect, occurrence)
                bad |= status not in ("done", "skipped")
                rows.append((b.book_id, int(e.seq), status, None))
            rows.append((b.book_id, -1, "refused" if bad else "written", (b.text or "") if bad else text))
        return pd.DataFrame(rows, columns=["book_id", "seq", "status", "text"])

    pairs = books.select("book_id", "text").groupBy("book_id").cogroup(plan.select("book_id", "seq", "op", "find", "with_", "expect", "occurrence").groupBy("book_id"))
    return pairs.applyInPandas(edit, "book_id string, seq int, status string, text string")
