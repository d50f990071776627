"""Translation planning: which lines are worth a request, a cache keyed by content, batches, and back-fill."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions.text import needs_translation
from quire.shipping import ship

MARKER = r"^(\s*(?:#{1,6}|[-•·☐□])\s+)(.*)$"
SPAN = r"`([^`]+)`|\$([^$]+)\$"


def cache_key(text: Column, source: str = "en", target: str = "zh", model: str = "default", prompt: str = "") -> Column:
    return F.sha2(F.concat(F.lit(f"{source}>{target}|{model}|{prompt}|"), text), 256)


def marker_split(line: Column) -> Column:
    """struct<mark, body>: heading or bullet marks apart, if what follows needs a translation."""
    body = F.regexp_extract(line, MARKER, 2)
    ok = needs_translation(body)
    return F.struct(F.when(ok, F.regexp_extract(line, MARKER, 1)).otherwise("").alias("mark"), F.when(ok, body).otherwise(line).alias("body"))


def protected(line: Column) -> Column:
    """Inline code and math in tags that keep which of the two they were."""
    return F.regexp_replace(F.regexp_replace(line, r"`([^`]+)`", '<keep k="c">$1</keep>'), r"\$([^$]+)\$", '<keep k="m">$1</keep>')


def restored(line: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(line, '<keep k="c">(.*?)</keep>', "`$1`"), '<keep k="m">(.*?)</keep>', r"\$$1\$")


def cache_misses(lines: DataFrame, cache: DataFrame) -> DataFrame:
    """Distinct (key, line) that the cache (key, translated) lacks."""
    return lines.select(cache_key(F.col("line")).alias("key"), "line").distinct().join(cache.select("key"), "key", "left_anti")


def back_filled(lines: DataFrame, cache: DataFrame) -> DataFrame:
    """lines with out: the cached translation, else the line itself."""
    keyed = lines.withColumn("key", cache_key(F.col("line")))
    return keyed.join(cache.select("key", "translated"), "key", "left").withColumn("out", F.coalesce("translated", "line")).drop("key", "translated")


def batches(lines: DataFrame, budget: int = 5500) -> DataFrame:
    """lines (doc_id, line_no, line) with the number of the request each goes into: as many lines as the budget of bytes holds.

    The fold over one document's sizes notes only where a request begins; its lines are those up to the next beginning. The lines
    are read, and kinds of lines found, once.
    """
    sizes = F.array_sort(F.collect_list(F.struct("line_no", F.octet_length("line").alias("n"))))
    start = F.struct(F.lit(0).alias("used"), F.lit(0).alias("at"), F.array(F.lit(1)).alias("begins"))

    def step(acc: Column, x: Column) -> Column:
        new = (acc["used"] > 0) & (acc["used"] + x["n"] > budget)
        begins = F.when(new, F.concat(acc["begins"], F.array(acc["at"] + 1))).otherwise(acc["begins"])
        return F.struct((F.when(new, 0).otherwise(acc["used"]) + x["n"]).alias("used"), (acc["at"] + 1).alias("at"), begins.alias("begins"))

    folded = lines.groupBy("doc_id").agg(sizes.alias("s")).select("doc_id", "s", F.explode(F.array(F.aggregate("s", start, step))).alias("f"))
    asked = folded.select("doc_id", "s", F.col("f.at").alias("all"), F.col("f.begins").alias("begins"))
    ends = F.concat(F.slice("begins", 2, F.size("begins")), F.array(F.col("all") + 1))
    numbered = F.transform(F.arrays_zip("begins", ends.alias("ends")), lambda b, i: F.transform(F.slice("s", b["begins"], b["ends"] - b["begins"]), lambda x: F.struct(x["line_no"].alias("line_no"), i.cast("long").alias("batch"))))
    return asked.select("doc_id", F.explode(F.flatten(numbered)).alias("x")).select("doc_id", "x.*")


def isolated(results: DataFrame, lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of batches' results (batch, ok): the lines (batch, line_no, line) of failed batches, to be asked for one by one, and
    those of the others. No line is dropped."""
    bad = results.where(~F.col("ok")).select("batch").distinct()
    return lines.join(bad, "batch", "left_semi"), lines.join(bad, "batch", "left_anti")


def upserted(cache: DataFrame, fresh: DataFrame) -> DataFrame:
    """The cache (key, translated) with fresh translations in place of older ones of the same key."""
    return cache.join(fresh.select("key"), "key", "left_anti").unionByName(fresh.select("key", "translated").dropDuplicates(["key"]))


def titles_translated(titles: DataFrame, cache: DataFrame) -> DataFrame:
    """titles (title) with their translation, or as they are."""
    keyed = titles.withColumn("key", cache_key(F.col("title")))
    return keyed.join(cache.select("key", "translated"), "key", "left").select(*titles.columns, F.coalesce("translated", "title").alias("shown"))


def regrouped(sources: DataFrame, fragments: DataFrame) -> DataFrame:
    """(batch, line_no, translated): consecutive fragments (batch, seq, src, dst) that together make exactly one source line
    (batch, line_no, line). A batch in which a fragment can't be placed gives no rows; its lines are asked for one by one.
    """
    ship(sources.sparkSession)

    def place(lines: pd.DataFrame, parts: pd.DataFrame) -> pd.DataFrame:
        rows, at = [], 0
        columns = {"batch": "int32", "line_no": "int32", "translated": "object"}
        nothing = pd.DataFrame({c: pd.Series(dtype=t) for c, t in columns.items()})
        parts = parts.sort_values("seq").reset_index(drop=True)
        for s in lines.sort_values("line_no").itertuples(index=False):
            src, dst = "", ""
            while at < len(parts) and src != s.line and s.line.startswith(src + parts["src"][at]):
                src, dst, at = src + parts["src"][at], dst + parts["dst"][at], at + 1
            if src != s.line:
                return nothing
            rows.append((s.batch, s.line_no, dst))
        return pd.DataFrame(rows, columns=list(columns)) if rows and at == len(parts) else nothing

    pairs = sources.select("batch", "line_no", "line").groupBy("batch").cogroup(fragments.select("batch", "seq", "src", "dst").groupBy("batch"))
    return pairs.applyInPandas(place, "batch int, line_no int, translated string")
