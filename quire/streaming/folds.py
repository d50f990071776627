"""Streams over files of events: folds whose state is one row for each key."""

from __future__ import annotations

import uuid
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

from quire.shipping import ship


def events(spark: SparkSession, folder: str, schema) -> DataFrame:
    """A file stream; schema is that of the batch table."""
    return spark.readStream.schema(schema).parquet(folder)


def alert_fold(stream: DataFrame) -> DataFrame:
    """(event_type, props, occurrences, last_event): to be written in update or complete mode."""
    return stream.groupBy("event_type", "props").agg(F.count("*").alias("occurrences"), F.max("event_id").alias("last_event"))


def latest_state(stream: DataFrame) -> DataFrame:
    """(user_id, n_events, last_type): the latest event of each job."""
    return stream.groupBy("user_id").agg(F.count("*").alias("n_events"), F.max_by("event_type", "event_id").alias("last_type"))


def windowed_counts(stream: DataFrame, late: str = "10 minutes", size: str = "1 hour") -> DataFrame:
    """Counts by event time; a window is final when the watermark has passed it."""
    timed = stream.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", late)
    return timed.groupBy(F.window("at", size), "event_type").agg(F.count("*").alias("n"))


def finished(stream: DataFrame, mode: str, folder: str) -> DataFrame:
    """The result of a stream over all files there are now. Appended rows go to files; each micro-batch of a complete result is written to the shared
    folder, and the last one is read; nothing goes through the driver."""
    out = f"{folder.rstrip('/')}/out-{uuid.uuid4().hex}"
    if mode == "append":
        query = stream.writeStream.outputMode(mode).format("parquet").option("path", out).option("checkpointLocation", f"{folder.rstrip('/')}/state").trigger(availableNow=True).start()
        query.awaitTermination()
        return stream.sparkSession.read.schema(stream.schema).parquet(out)
    query = stream.writeStream.outputMode(mode).foreachBatch(lambda batch, n: batch.write.mode("overwrite").parquet(f"{out}/{n}")).option("checkpointLocation", f"{folder.rstrip('/')}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    last = (query.lastProgress or {}).get("batchId", 0)
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{out}/{last}")


def flagged_pages(stream: DataFrame, detectors) -> DataFrame:
    """Findings of a stream of pages (book_id, page_no, doc_id, text), by detectors of single pages: a map, without state."""
    return reduce(DataFrame.unionByName, [d(stream) for d in detectors])


def stuck_jobs(stream: DataFrame, after: str = "6 hours", late: str = "10 minutes") -> DataFrame:
    """(user_id, n_events, last_type, last_ts) of jobs of which nothing came for so long, by event time: a time-out on each job's state.

    A job's state is its latest event; a new event moves its time-out, so a job that goes on isn't stuck. To be written in append mode.
    """
    ship(stream.sparkSession)
    wait = pd.Timedelta(after).value // 1_000_000

    def step(key, batches, state):
        n, kind, order, last = state.get if state.exists else (0, None, -1, 0)
        if state.hasTimedOut:
            state.remove()
            yield pd.DataFrame({"user_id": [key[0]], "n_events": [n], "last_type": [kind], "last_ts": [pd.Timestamp(last, unit="us")]})
            return
        for b in batches:
            n += len(b)
            newest = b.loc[b["event_id"].idxmax()]
            if newest["event_id"] > order:
                order, kind = int(newest["event_id"]), newest["event_type"]
            last = max(last, int(b["us"].max()))
        state.update((n, kind, order, last))
        state.setTimeoutTimestamp(max(last // 1000 + wait, state.getCurrentWatermarkMs() + 1))

    timed = stream.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", late).withColumn("us", F.unix_micros("at"))
    rows = timed.select("user_id", "event_id", "event_type", "at", "us")
    return rows.groupBy("user_id").applyInPandasWithState(step, "user_id long, n_events long, last_type string, last_ts timestamp", "n long, kind string, ord long, last long", "append", GroupStateTimeout.EventTimeTimeout)
