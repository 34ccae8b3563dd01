"""Structured Streaming: daily counters, distinct visitors, rate limits, and a keyed upsert sink."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_events(spark: SparkSession, path: str, files_per_trigger: int = 1) -> DataFrame:
    """Event files as a stream. The files' wall-clock times become timestamps, as watermarks ask for."""
    batch = spark.read.parquet(path)
    folder, _, name = path.rstrip("/").rpartition("/")
    alone = [f.rpartition("/")[2] for f in batch.inputFiles()] == [name]  # a stream reads folders
    reader = spark.readStream.schema(batch.schema).option("maxFilesPerTrigger", files_per_trigger)
    s = reader.option("pathGlobFilter", name).parquet(folder) if alone else reader.parquet(path)
    return s.withColumn("ts", F.col("ts").cast("timestamp"))


def daily_counts(events: DataFrame, late: str = "1 day") -> DataFrame:
    """Counts of kinds by day of the event. In complete mode all days show; in append mode a day
    shows once the watermark has passed it."""
    day = F.window("ts", "1 day").alias("w")
    return events.withWatermark("ts", late).groupBy(day, "event_type").agg(F.count("*").alias("n")).select(F.date_format("w.start", "yyyy-MM-dd").alias("day"), "event_type", "n")


def daily_visitors(events: DataFrame, late: str = "1 day") -> DataFrame:
    """The first event of each visitor of a day, as it comes: insert or ignore."""
    d = events.withWatermark("ts", late).withColumn("day", F.window("ts", "1 day")["start"])
    return d.dropDuplicatesWithinWatermark(["day", "user_id"]).select(F.date_format("day", "yyyy-MM-dd").alias("day"), "user_id")


def under_limit(events: DataFrame, limit: int, late: str = "1 day") -> DataFrame:
    """The first `limit` events of each user and day; the count is the state, and ends with the day."""

    def admit(key, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        n = state.get[0] if state.exists else 0
        for f in frames:
            f = f.sort_values("event_id")
            room = max(0, limit - n)
            n += len(f)
            yield f.head(room)[["event_id", "user_id", "day"]]
        state.update((n,))
        day_end = int(pd.Timestamp(key[1]).timestamp() * 1000) + 2 * 86_400_000
        state.setTimeoutTimestamp(max(day_end, state.getCurrentWatermarkMs() + 1))

    d = events.withWatermark("ts", late).withColumn("day", F.date_format("ts", "yyyy-MM-dd"))
    return d.groupBy("user_id", "day").applyInPandasWithState(admit, "event_id long, user_id long, day string", "n long", "append", "EventTimeTimeout")


def upsert_into(path: str, keys: list[str], n: str):
    """A foreachBatch sink that adds a batch's counters to a Parquet table, one folder for each
    state; the newest holds. A batch that is tried again finds its state there and is left out."""

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        from ..operators.writes import upsert_add

        at = f"{path}/state={batch_id:012d}"
        changes = batch.groupBy(*keys).agg(F.sum(n).alias(n))
        if batch_id:
            changes = upsert_add(spark.read.parquet(f"{path}/state={batch_id - 1:012d}"), changes, keys, n)
        changes.write.mode("ignore").parquet(at)

    return write


def run_once(stream: DataFrame, mode: str, name: str, checkpoint: str) -> None:
    """Runs a stream over all that is there, into a memory table (for tests and small results)."""
    q = stream.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    if q.exception():
        raise q.exception()
