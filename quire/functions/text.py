"""String expressions. All are built-in Catalyst expressions; patterns avoid \\b and ASCII-only \\s where that matters."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Unicode white space, as str.strip takes it, for Java's and RE2's classes.
WS = r"\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
TRIM = rf"^[{WS}]+|[{WS}]+$"
#: The same characters, as a set.
SPACES = "".join(map(chr, (*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))
TAG = r"<[^>]+>"


def ustrip(c: Column) -> Column:
    """Without white space at both ends, Unicode's included (trim knows the space only)."""
    return F.btrim(c, F.lit(SPACES))


def plain(c: Column) -> Column:
    """Without tags, runs of white space as one space, stripped."""
    return F.trim(F.regexp_replace(F.regexp_replace(c, TAG, ""), rf"[{WS}]+", " "))


def squashed(c: Column) -> Column:
    """Without tags and white space, lower case: tells whether a word occurs written differently."""
    return F.lower(F.regexp_replace(F.regexp_replace(c, TAG, " "), rf"[{WS}]+", ""))


def strip_math(c: Column) -> Column:
    """Without display math, then without inline math."""
    return F.regexp_replace(F.regexp_replace(c, r"(?s)\$\$.*?\$\$", ""), r"\$[^$\n]*\$", "")


def alnum_length(c: Column) -> Column:
    return F.length(F.regexp_replace(c, r"[^\p{L}\p{N}]", ""))


def slug(c: Column) -> Column:
    """Runs of other characters than letters, digits, _ and - as one hyphen, 60 characters at most."""
    s = F.regexp_replace(F.regexp_replace(c, r"[^\p{L}\p{N}_-]+", "-"), r"^-+|-+$", "")
    return F.left(F.regexp_replace(s, "-{2,}", "-"), F.lit(60))


def title_key(c: Column) -> Column:
    """Letters and digits in lower case, of every script: titles without Latin letters keep a key of their own."""
    return F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]+", "")


def safe_name(c: Column) -> Column:
    """The last part of a path, without other characters than letters, digits, _, . and -."""
    return F.regexp_replace(F.regexp_replace(F.regexp_extract(c, r"([^/\\]*)$", 1), r"[^\p{L}\p{N}_.\-]+", "_"), r"^[._]+|[._]+$", "")


def paragraphs(c: Column) -> Column:
    """Blocks between blank lines, stripped, without empty ones."""
    return F.filter(F.transform(F.split(c, r"\n\s*\n"), ustrip), lambda x: x != "")


def lines(c: Column) -> Column:
    return F.split(c, "\n")


def needs_translation(c: Column) -> Column:
    """At least four ASCII letters; a text is read to the fourth only."""
    return c.rlike("^(?:[^A-Za-z]*+[A-Za-z]){4}")


def occurrences(text: Column, part: Column) -> Column:
    """How often part occurs in text, without overlap; 0 for an empty part."""
    return F.when(F.length(part) == 0, 0).otherwise(((F.length(text) - F.length(F.replace(text, part, F.lit("")))) / F.length(part)).cast("int"))


def excerpt(text: Column, needle: Column, limit: int = 400) -> Column:
    """The text around the needle's first line (60 characters of it), with ellipses where it is cut; empty if absent."""
    key = F.left(F.split(ustrip(needle), "\n")[0], F.lit(60))
    half = max(80, limit // 2)
    at = F.position(key, text)
    start, end = F.greatest(F.lit(0), at - 1 - half), F.least(F.length(text), at - 1 + half)
    cut = F.substring(text, start + 1, end - start)
    whole = F.concat(F.when(start > 0, "…").otherwise(""), cut, F.when(end < F.length(text), "…").otherwise(""))
    return F.when((key == "") | (at == 0), "").otherwise(whole)


def entities_escaped(c: Column) -> Column:
    return F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def ordered_concat(order: str, value: str, separator: str) -> Column:
    """An aggregate: the group's values in the order of a column, joined."""
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order), F.col(value)))), lambda x: x[value]), separator)
