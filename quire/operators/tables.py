"""HTML tables in page text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TABLE, ROW, CELL, TAG = r"(?s)<table.*?</table>", r"(?s)<tr.*?</tr>", r"(?s)<td.*?</td>", r"<[^>]+>"
#: Fixed value: a table's caption, the last one in the characters before it.
CAPTION = r"(表\s*[\dA-Za-z.\-]+[^\n<]{0,60})"


def needs_image(cols: Column, rows: Column) -> Column:
    """Too wide for a phone: nine columns, six columns and 15 rows, or 150 cells."""
    return (cols >= 9) | ((cols >= 6) & (rows >= 15)) | (cols * rows >= 150)


def inventory(pages: DataFrame) -> DataFrame:
    """(page_no, ord, rows, cols, chars, ragged, caption, needs_image, too_long) of every table."""
    all_ = lambda c, p: F.regexp_extract_all(c, F.lit(p), F.lit(0))
    text = F.coalesce("text", F.lit(""))
    t = pages.select("page_no", F.split(text, r"(?s)<table.*?</table>").alias("between"), F.posexplode(all_(text, TABLE)).alias("i", "html"))
    cells = F.transform(all_("html", ROW), lambda r: F.regexp_count(r, F.lit(CELL)))
    # Behind a generator, conditions on what is made of the cells don't count them again, least of all once for each row.
    t = t.withColumn("c", F.explode(F.array(F.struct(cells.alias("cells"))))).withColumn("cells", F.col("c.cells"))
    t = t.withColumn("cols", F.coalesce(F.array_max("cells"), F.lit(0))).withColumn("rows", F.size("cells"))
    caption = F.coalesce(F.trim(F.try_element_at(F.regexp_extract_all(F.right(F.col("between")[F.col("i")], F.lit(200)), F.lit(CAPTION), F.lit(1)), F.lit(-1))), F.lit(""))
    ragged = F.array_sort(F.array_distinct(F.filter(F.array_remove("cells", F.col("cols")), lambda c: c > 1)))
    chars = F.length(F.regexp_replace("html", TAG, ""))
    return t.select("page_no", (F.col("i") + 1).alias("ord"), "rows", "cols", chars.alias("chars"), F.array_join(ragged.cast("array<string>"), ",").alias("ragged"), caption.alias("caption"), needs_image(F.col("cols"), F.col("rows")).alias("needs_image"), (chars > 1200).alias("too_long"))


def rows_missing(table_rows: DataFrame, layer: DataFrame) -> DataFrame:
    """(page_no, row_no, key, found) of table rows (page_no, row_no, key, words) against the lines of the text layer
    (page_no, line): a line of the page begins with the squashed key and has all words."""
    squash = lambda c: F.lower(F.regexp_replace(c, r"\s+", ""))
    a = table_rows.withColumn("k", squash(F.col("key")))
    b = layer.select(F.col("page_no").alias("p"), squash(F.col("line")).alias("flat"))
    hit = a.join(b, (F.col("page_no") == F.col("p")) & F.col("flat").startswith(F.col("k")) & F.forall("words", lambda w: F.contains("flat", squash(w))))
    hit = hit.select("page_no", "row_no").distinct().withColumn("found", F.lit(True))
    return table_rows.join(hit, ["page_no", "row_no"], "left").select("page_no", "row_no", "key", F.coalesce("found", F.lit(False)).alias("found"))


def over_limit(inventory: DataFrame) -> DataFrame:
    """The tables that don't fit a phone, the widest and longest first."""
    return inventory.where(F.col("needs_image") | F.col("too_long")).orderBy(F.desc("cols"), F.desc("rows"), "page_no", "ord")
