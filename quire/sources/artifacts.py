"""Files of a parse result: which file plays which role, natural order, and text of unknown encoding."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Patterns of file names for each role, in order of preference.
ROLES = {
    "markdown": ("full\\.md", ".*\\.md"),
    "content_list": (".*content_list\\.json",),
    "model": (".*model\\.json", ".*layout\\.json"),
    "middle": (".*middle\\.json",),
}


def located(files: DataFrame, roles: dict[str, tuple[str, ...]] = ROLES) -> DataFrame:
    """(bundle, role, path): for each role the file (bundle, path) of the best pattern, then the shallowest, then the first by name.
    Hidden files and folders are left out."""
    name = F.regexp_extract("path", "([^/]*)$", 1)
    options = [F.struct(F.lit(r).alias("role"), F.lit(i).alias("rank"), F.lit(f"^{p}$").alias("pattern")) for r, ps in roles.items() for i, p in enumerate(ps)]
    f = files.where(~F.col("path").rlike(r"(^|/)\.")).withColumn("o", F.explode(F.array(*options))).where(F.expr("regexp_extract(path, '([^/]*)$', 1) rlike o.pattern")).withColumn("name", name)
    order = Window.partitionBy("bundle", "o.role").orderBy("o.rank", F.size(F.split("path", "/")), "path")
    return f.withColumn("nth", F.row_number().over(order)).where("nth = 1").select("bundle", F.col("o.role").alias("role"), "path")


def unclaimed(files: DataFrame, roles: dict[str, tuple[str, ...]] = ROLES) -> DataFrame:
    """(bundle, path) of JSON files that no role's pattern names, the shallowest first by name: a result of an unknown layout may be among them."""
    name = F.regexp_extract("path", "([^/]*)$", 1)
    known = name.rlike("^(?:" + "|".join(p for ps in roles.values() for p in ps) + ")$")
    return files.where(~F.col("path").rlike(r"(^|/)\.") & name.rlike(r"\.json$") & ~known).select("bundle", "path")


def unusable(files: DataFrame, roles: dict[str, tuple[str, ...]] = ROLES, wanted: tuple[str, ...] = ("markdown", "content_list")) -> DataFrame:
    """(bundle, n_files) of bundles that have none of the wanted roles: nothing of them can be used."""
    usable = located(files, roles).where(F.col("role").isin(*wanted)).select("bundle").distinct()
    return files.groupBy("bundle").agg(F.count("*").alias("n_files")).join(usable, "bundle", "left_anti")


def natural_key(name: Column) -> Column:
    """A sort key in which numbers count by their value: digits are padded to twenty places."""
    parts = F.regexp_extract_all(name, F.lit(r"\d+|\D+"), F.lit(0))
    return F.array_join(F.transform(parts, lambda p: F.when(p.rlike(r"^\d"), F.lpad(p, 20, "0")).otherwise(F.lower(p))), "")


def decoded(files: DataFrame) -> DataFrame:
    """files (path, content) with text: UTF-8 with or without a mark, else GB 18030, else UTF-16, else UTF-8 with replacements.
    Sound UTF-8 never reaches the Python function."""

    @F.pandas_udf("string")
    def guess(contents: pd.Series) -> pd.Series:
        def one(c):
            for encoding in ("gb18030", "utf-16"):
                try:
                    return bytes(c).decode(encoding)
                except UnicodeDecodeError:
                    pass
            return bytes(c).decode("utf-8", "replace")

        return pd.Series([None if c is None else one(c) for c in contents], dtype="object")

    utf8 = F.regexp_replace(F.decode("content", "UTF-8"), r"^\x{feff}", "")
    sound = files.where(F.is_valid_utf8(F.col("content").cast("string"))).withColumn("text", utf8)
    return sound.unionByName(files.where(~F.is_valid_utf8(F.col("content").cast("string"))).withColumn("text", guess("content")))
