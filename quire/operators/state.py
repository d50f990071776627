"""State of runs, stages and alerts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

STAGES = ("prepare", "calibrate", "compose", "check")
LEVELS = ("INFO", "WARNING", "ERROR", "CRITICAL")


def first_incomplete(stages: DataFrame) -> DataFrame:
    """(run_id, stage) of rows (run_id, stage, ord, status): the first stage that is neither DONE nor SKIPPED."""
    return stages.where(~F.col("status").isin("DONE", "SKIPPED")).groupBy("run_id").agg(F.min_by("stage", "ord").alias("stage"))


def latest_run(runs: DataFrame) -> DataFrame:
    return runs.agg(F.max_by("run_id", "created_at").alias("run_id"))


def folded_alerts(alerts: DataFrame) -> DataFrame:
    """(code, message, occurrences, created_at, severity): one alert for each code and message, with the latest time and the
    severity it first had. alerts: code, message, severity, ts, alert_id; if they have a context, the fold has the latest that isn't empty."""
    at = F.struct("ts", "alert_id")
    more = [F.max_by("context", F.when(F.length("context") > 0, at)).alias("context")] if "context" in alerts.columns else []
    return alerts.groupBy("code", "message").agg(F.count("*").alias("occurrences"), F.max("ts").alias("created_at"), F.min_by("severity", at).alias("severity"), *more)


def exit_code(alerts: DataFrame) -> DataFrame:
    """One row exit_code: 2 if any alert is a warning or graver, else 0."""
    return alerts.agg(F.when(F.coalesce(F.bool_or(F.col("severity").isin(*LEVELS[1:])), F.lit(False)), 2).otherwise(0).alias("exit_code"))


def noticed(alerts: DataFrame, severity: str | None = None, limit: int = 50) -> DataFrame:
    """The newest alerts of a severity, or of any; a report, whose limit is its feature."""
    few = alerts if severity is None else alerts.where(F.upper("severity") == severity.upper())
    return few.orderBy(F.desc("ts"), F.desc("alert_id")).limit(limit)


def last_severity(alerts: DataFrame) -> DataFrame:
    """(code, severity): what each code was when it came up last."""
    return alerts.groupBy("code").agg(F.max_by("severity", F.struct("ts", "alert_id")).alias("severity"))


def known_states(lines: DataFrame, schema: str) -> DataFrame:
    """States (file, value) read as JSON objects of a schema; a state that can't be read is left out, the others stay."""
    read = lines.withColumn("s", F.from_json("value", f"struct<{schema}, _bad: string>", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}))
    return read.where("s is not null and s._bad is null").select("file", "s.*").drop("_bad")


def local_time(epoch):
    """Seconds since 1970 as an ISO time in the session's zone."""
    return F.date_format(F.timestamp_seconds(epoch), "yyyy-MM-dd'T'HH:mm:ssXXX")


def duration(start, end):
    """Seconds between two times in seconds, to the millisecond."""
    return F.round(end - start, 3)


def stale(sources: DataFrame, seen: DataFrame) -> DataFrame:
    """(name, digest, status) of sources (name, content): new, changed or same against the digests (name, digest) seen before."""
    now = sources.select("name", F.sha2("content", 256).alias("digest"))
    j = now.join(seen.select("name", F.col("digest").alias("before")), "name", "left")
    return j.select("name", "digest", F.when(F.col("before").isNull(), "new").when(F.col("before") != F.col("digest"), "changed").otherwise("same").alias("status"))


def to_run(stages: DataFrame, until: int | None = None, force: int | None = None) -> DataFrame:
    """(run_id, stage, ord) of the stages that a resumed run still has to go through: the first incomplete one and all after it,
    whatever their status, up to the stage with the number until. stages: run_id, stage, ord, status.

    force: the stage with that number is gone through again, and so are all after it, in any run.
    """
    again = ~F.col("status").isin("DONE", "SKIPPED")
    first = stages.where(again if force is None else again | (F.col("ord") == force)).groupBy("run_id").agg(F.min("ord").alias("first"))
    left = stages.join(first, "run_id").where("ord >= first")
    return (left if until is None else left.where(F.col("ord") <= until)).select("run_id", "stage", "ord")


def invalidated(stages: DataFrame, changed: DataFrame) -> DataFrame:
    """stages with the status of those behind a changed one (run_id, ord) set to PENDING: their inputs aren't what they were made of."""
    least = changed.groupBy("run_id").agg(F.min("ord").alias("__since"))
    new = F.when(F.col("ord") > F.col("__since"), "PENDING").otherwise(F.col("status"))
    return stages.join(least, "run_id", "left").withColumn("status", new).select(*stages.columns)


def fingerprint(row: list[str]):
    """16 hex digits of the canonical JSON of columns, in the order given."""
    return F.left(F.sha2(F.to_json(F.struct(*row)), 256), F.lit(16))


def counts_json(counts: DataFrame) -> DataFrame:
    """One row counts: the rows (key, n) of a count as a JSON object, keys in order. Keys are kinds, so there are few."""
    sorted_ = F.array_sort(F.collect_list(F.struct("key", "n")))
    return counts.agg(F.to_json(F.map_from_entries(sorted_)).alias("counts"))
