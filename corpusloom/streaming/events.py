"""Structured Streaming over the event files: windows, dedup, stateful floors and an idempotent sink."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

from corpusloom.sources.tables import SCHEMAS


def read_events(spark: SparkSession, path: str, files_per_trigger: int = 1) -> DataFrame:
    """Event files as a stream; event time is cast so that it can carry a watermark."""
    stream = spark.readStream.schema(SCHEMAS["events"]).option("maxFilesPerTrigger", files_per_trigger).parquet(path)
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))


def tumbling(events: DataFrame, late: str = "1 hour", size: str = "1 hour") -> DataFrame:
    w = events.withWatermark("ts", late).groupBy(F.window("ts", size), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 3).alias("total"))
    return w.select(F.col("window.start").alias("start"), "event_type", "n", "total")


def sliding(events: DataFrame, late: str = "1 hour", size: str = "2 hours", step: str = "1 hour") -> DataFrame:
    w = events.withWatermark("ts", late).groupBy(F.window("ts", size, step)).agg(F.count(F.lit(1)).alias("n"))
    return w.select(F.col("window.start").alias("start"), "n")


def sessions(events: DataFrame, late: str = "1 hour", gap: str = "1 hour") -> DataFrame:
    w = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "user_id").agg(F.count(F.lit(1)).alias("n"))
    return w.select("user_id", F.col("session_window.start").alias("start"), "n")


def deduplicated(events: DataFrame, late: str | None = None) -> DataFrame:
    """Every event once, and every event without an id.

    Without ``late`` nothing is dropped as too late, and the state holds a key of every event. With it
    the state is bounded, and events that are older than the newest by more than that are dropped.
    """
    if late is None:
        keyed = events.withColumn("unknown", F.when(F.col("event_id").isNull(), F.uuid()))
        return keyed.dropDuplicates(["event_id", "unknown"]).drop("unknown")
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])


def floor_state(events: DataFrame, lane: str = "error", floor: float = 0.25) -> DataFrame:
    """Per user, delivered and needed counts of a protected lane, kept in the state store across batches."""
    import pandas as pd

    def update(key, frames, state):
        seen, served = state.get if state.exists else (0, 0)
        for pdf in frames:
            seen += len(pdf)
            served += int((pdf["event_type"] == lane).sum())
        state.update((seen, served))
        need = max(0, -int(-floor * seen // 1) - served)
        yield pd.DataFrame({"user_id": [key[0]], "seen": [seen], "served": [served], "needed": [need]})

    return events.groupBy("user_id").applyInPandasWithState(
        update, "user_id long, seen long, served long, needed long", "seen long, served long", "update", GroupStateTimeout.NoTimeout
    )


def append_ledger(target: str) -> Callable[[DataFrame, int], None]:
    """A foreachBatch sink that writes each batch to its own folder, so that a batch written again replaces itself."""

    def write(batch: DataFrame, batch_id: int) -> None:
        offset = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
        batch.withColumn("offset", offset).write.mode("overwrite").parquet(f"{target}/batch={batch_id}")

    return write


def run_once(df: DataFrame, target: str, checkpoint: str, mode: str = "append") -> int | None:
    """Process what is there and stop; the number of the last batch. Complete and update results are kept by batch; the last batch of ``complete`` is the result."""
    last: list[int] = []

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{target}/batch={batch_id}")
        last[:] = [batch_id]

    query = df.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(write).start()
    query.awaitTermination()
    return last[0] if last else None


def of_batch(spark: SparkSession, target: str, batch: int) -> DataFrame:
    """The rows of one batch; no other batch's files are listed or read."""
    return spark.read.parquet(f"{target}/batch={batch}")
