"""Exact times online of every user on a stream, with late rows."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.work import shared_folder
from . import replay

INTERVAL = "user_id long, start timestamp, end timestamp"
STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def online_intervals(stream: DataFrame, minutes: float = 5, late: str = "2 hours") -> DataFrame:
    """(user_id, start, end): the stretches in which a user's last activity is at most ``minutes`` ago, each once.

    ``stream`` has user_id and ts, which counts in milliseconds. A stretch comes when the watermark has passed its end,
    so rows that are up to ``late`` behind are all counted, in whatever order they come; the state of a user is the
    stretches still open.
    """
    stream.sparkSession.conf.set(STORE, ROCKS)
    held = stream.filter("user_id is not null and ts is not null").select("user_id", F.date_trunc("millisecond", "ts").alias("ts")).withWatermark("ts", late)
    # A session ends before its gap does, and activities that are exactly ``minutes`` apart are one stretch.
    gap = int(minutes * 60_000)
    stretches = held.groupBy("user_id", F.session_window("ts", f"{gap + 1} milliseconds").alias("s")).agg(F.count("*").alias("activities"))
    return stretches.select("user_id", F.col("s.start").alias("start"), (F.col("s.end") - F.expr("interval 1 millisecond")).alias("end"))


def online_at(intervals: DataFrame, as_of: str) -> DataFrame:
    """Users that are online at a time, from their stretches."""
    now = F.lit(as_of).cast("timestamp")
    return intervals.filter((F.col("start") <= now) & (F.col("end") >= now)).select("user_id").distinct()


def replay_online(spark: SparkSession, folder: str, as_of: str, minutes: float, late: str = "2 hours") -> DataFrame:
    """Users online at ``as_of``, by streaming all event files of a folder into a table of stretches."""
    root = f"{shared_folder(spark)}/online-{uuid.uuid4().hex}"
    query = (
        online_intervals(replay.events(spark, folder), minutes, late)
        .writeStream.outputMode("append").format("parquet").option("path", f"{root}/intervals").option("checkpointLocation", f"{root}/checkpoint")
        .trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return online_at(spark.read.schema(INTERVAL).parquet(f"{root}/intervals"), as_of)
