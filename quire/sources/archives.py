"""Archives as rows: entries of zip files, read with Spark's binaryFile so that any store Spark knows will do."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.shipping import ship

ENTRY = "epub string, ord int, name string, stored boolean, content binary"


def entries(archives: DataFrame) -> DataFrame:
    """(epub, ord, name, stored, content) of archives (path, content), in their order. A file that is no zip, or an
    empty one, gives one row with a null name; its content is empty, or null. Names that leave the archive (absolute, or with ..) are skipped. An archive is read in one task."""
    ship(archives.sparkSession)

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import io
        import zipfile

        for b in batches:
            for path, content in zip(b["path"], b["content"], strict=True):
                try:
                    z = zipfile.ZipFile(io.BytesIO(content))
                except zipfile.BadZipFile:
                    yield pd.DataFrame({"epub": [path], "ord": [-1], "name": [None], "stored": [None], "content": [b""]})
                    continue
                if not z.infolist():
                    yield pd.DataFrame({"epub": [path], "ord": [-1], "name": [None], "stored": [None], "content": [None]})
                for i, e in enumerate(z.infolist()):
                    if not e.filename.startswith("/") and ".." not in e.filename.split("/"):
                        yield pd.DataFrame({"epub": [path], "ord": [i], "name": [e.filename], "stored": [e.compress_type == zipfile.ZIP_STORED], "content": [z.read(e)]})

    return archives.select("path", "content").mapInPandas(read, ENTRY)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    return entries(spark.read.format("binaryFile").load(path))


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """(file, line_no, value) of text files, lines numbered from 1 within each file.

    Spark cuts large files at line ends, so many tasks read one file. A row knows its block of the file and its place in it; lines are numbered by
    prefix sums of the blocks' counts, one row a block: no line is shuffled, whatever its file's size.
    """
    at = F.col("_metadata")
    lines = spark.read.text(path).select(at["file_path"].alias("file"), at["file_block_start"].alias("block"), F.monotonically_increasing_id().alias("id"), "value")
    blocks = lines.groupBy("file", "block").agg(F.min("id").alias("first"), F.count("*").alias("n"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = blocks.select("file", "block", (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first")).alias("shift"))
    return lines.join(starts, ["file", "block"]).select("file", (F.col("id") + F.col("shift") + 1).alias("line_no"), "value")
