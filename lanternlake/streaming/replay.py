"""Event streams: windowed counts with late data, recent activity, and refreshed figures."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources.work import shared_folder

EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def events(spark: SparkSession, folder: str, files_per_batch: int = 8) -> DataFrame:
    """Stream of the event files that appear in a folder."""
    stream = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", files_per_batch).option("pathGlobFilter", "events*.parquet")
    return stream.parquet(folder).withColumn("ts", F.col("ts").cast("timestamp"))


def windowed_counts(stream: DataFrame, window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Events and mean value of each type and window; state is dropped once the watermark has passed."""
    return (
        stream.withWatermark("ts", late)
        .groupBy(F.window("ts", window), "event_type")
        .agg(F.count("*").alias("events"), F.round(F.avg("value"), 4).alias("avg_value"))
    )


def recent_users(stream: DataFrame, minutes: int = 5) -> DataFrame:
    """Approximate number of users in sliding windows of some minutes; exact distinct counts need all state."""
    return stream.withWatermark("ts", f"{minutes} minutes").groupBy(F.window("ts", f"{minutes} minutes", "1 minute")).agg(
        F.approx_count_distinct("user_id").alias("users")
    )


def refresh(stream: DataFrame, action: Callable[[DataFrame, int], None], checkpoint: str, seconds: int = 1) -> StreamingQuery:
    """Call ``action`` on each micro-batch, at most once in ``seconds``: changes in between are one refresh."""
    return stream.writeStream.foreachBatch(action).option("checkpointLocation", checkpoint).trigger(processingTime=f"{seconds} seconds").start()


def replay(spark: SparkSession, folder: str, window: str = "1 day", late: str = "10 days") -> DataFrame:
    """Counts of all events in a folder by window and type, streamed to the end; one row per window and type.

    Changed counts go to a folder of their batch, which a second run of the batch replaces, and the last count of
    each window and type is the result, so that neither the driver nor one task holds all of them.
    """
    root = f"{shared_folder(spark)}/replay-{uuid.uuid4().hex}"

    def write(counts: DataFrame, batch: int) -> None:
        counts.write.mode("overwrite").parquet(f"{root}/counts/batch={batch}")

    counts = windowed_counts(events(spark, folder), window, late).select(F.date_format("window.start", "yyyy-MM-dd").alias("day"), "event_type", "events")
    query = counts.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    found = spark.read.schema("day string, event_type string, events long, batch long").parquet(f"{root}/counts")
    return found.groupBy("day", "event_type").agg(F.max_by("events", "batch").alias("events"))
