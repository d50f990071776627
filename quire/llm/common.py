"""Small helpers that the operators of this subpackage share."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters of the class ``[\x20\x09-\x0D]``.
BLANKS = " \t\n\x0b\f\r"
#: The class of word characters that the contracts use, for Java's regular expressions.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Only where a local session has none (as in tests) a temporary folder is set instead; on a cluster that is an error, since
    executors couldn't read what the driver writes to its own disk.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="quire-")
        spark.sparkContext.setCheckpointDir(found)
    return found


def _own_dir(spark: SparkSession) -> str:
    return f"{shared_dir(spark).rstrip('/')}/quire/{spark.sparkContext.applicationId}"


def clear(spark: SparkSession) -> None:
    """Deletes all tables that this application's operators have stored; for use when their results are written."""
    path = spark._jvm.org.apache.hadoop.fs.Path(_own_dir(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


#: The tables that stored has written, in order.
_written: list[str] = []


def written() -> int:
    """How many tables stored has written so far: a mark for forget."""
    return len(_written)


def forget(spark: SparkSession, first: int, last: int) -> None:
    """Deletes the tables written between two marks. For tables that no later plan reads."""
    for path in _written[first:last]:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def stored(df: DataFrame, what: str) -> DataFrame:
    """df written as a Parquet table in the shared folder and read again.

    This cuts the lineage, survives lost executors, and gives the planner the real size of the table. Results read such
    tables, so they stay until the application calls clear.
    """
    spark = df.sparkSession
    path = f"{_own_dir(spark)}/{what}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.append(path)
    return spark.read.schema(df.schema).parquet(path)


def by_shuffle(df: DataFrame) -> DataFrame:
    """df as a side of a join of two tables that grow with the input: neither is broadcast, whatever Spark takes their sizes for.

    It reckons with compressed files, with one element an array, and with one row out of Python for each row in, so it may be off
    by a factor of 100, and a table of a few MB by its reckoning may not fit the driver.
    """
    return df.hint("merge")


def id_bucket(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo modulus: the folds of the contracts."""
    return F.crc32(doc_id.cast("string")) % modulus


def hash_sample(df: DataFrame, key: Column, bound: int, seed: int = 0) -> DataFrame:
    """At most bound rows, chosen by a hash of key: the same rows on every run.

    For fitting models only. Rows are counted first, so that a filter does the work; the few rows by which the filter
    overshoots are cut in the order of their hashes.
    """
    n = df.count()
    if n <= bound:
        return df
    place = F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(2**30))
    return df.where(place < int(2**30 * 0.98 * bound / n)).orderBy(place, key).limit(bound)


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors' Python workers, once for each application."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    root = Path(__file__).resolve().parents[1]
    archive = Path(tempfile.mkdtemp(prefix="quire-")) / "quire-package.zip"
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    context.addPyFile(str(archive))
    _shipped.add(context.applicationId)
