"""Daily figures kept up to date from a stream: each batch computes anew only the days that it touches, exactly once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.reports import bucket_label

PARTIALS = "bucket string, user_id long, questions long, latency long, timed long, batch long"
FIGURES = "bucket string, questions long, users long, avg_latency double, batch long"


def partials(chats: DataFrame) -> DataFrame:
    """Mergeable figures of chats: by day and user their number, and the latency in whole thousandths with its count."""
    day = bucket_label(F.col("created_at"), "day").alias("bucket")
    latency = F.round(F.col("latency_ms") * 1000).cast("long")
    return chats.groupBy(day, "user_id").agg(F.count("*").alias("questions"), F.sum(latency).alias("latency"), F.count("latency_ms").alias("timed"))


def merged(parts: DataFrame) -> DataFrame:
    """Figures of each day from partial ones: equal to those of all its rows at once."""
    return parts.groupBy("bucket").agg(
        F.sum("questions").alias("questions"), F.countDistinct("user_id").alias("users"), (F.sum("latency") / F.sum("timed") / 1000).alias("avg_latency")
    )


def apply_batch(chats: DataFrame, batch: int, root: str, prepare: Callable[[DataFrame], DataFrame] | None = None) -> None:
    """Take a batch of chats into the figures below ``root``.

    Everything a batch writes lies in folders of its number, which a second run of the batch replaces, so that a batch
    counts once however often it is started. Partial figures are laid out by day, and only the days that the batch touches are
    read and computed again, from the batches before it and its own.
    """
    spark = chats.sparkSession
    mine = partials(prepare(chats) if prepare else chats)
    mine.write.mode("overwrite").partitionBy("bucket").parquet(f"{root}/partials/batch={batch}")
    own = spark.read.schema(PARTIALS).option("basePath", f"{root}/partials").parquet(f"{root}/partials/batch={batch}")
    days = [r[0] for r in own.select("bucket").distinct().collect()]  # days of one batch
    every = spark.read.schema(PARTIALS).option("basePath", f"{root}/partials").parquet(f"{root}/partials")
    touched = every.filter(F.col("bucket").isin(days) & (F.col("batch") <= batch)) if days else every.limit(0)
    merged(touched).write.mode("overwrite").parquet(f"{root}/figures/batch={batch}")


def figures(spark: SparkSession, root: str, upto: int | None = None) -> DataFrame:
    """The figures of every day: for each the ones of the last batch that touched it."""
    found = spark.read.schema(FIGURES).parquet(f"{root}/figures")
    if upto is not None:
        found = found.filter(F.col("batch") <= upto)
    last = found.groupBy("bucket").agg(F.max_by(F.struct("questions", "users", "avg_latency"), "batch").alias("x"))
    return last.select("bucket", "x.*")


def keep_figures(stream: DataFrame, root: str, prepare: Callable[[DataFrame], DataFrame] | None = None, seconds: float | None = 1, before: Callable[[int], None] | None = None) -> StreamingQuery:
    """Start to keep figures from a stream; batches begin at most once in ``seconds``, and None is one run to the end.

    A query that was stopped anywhere goes on from its checkpoint below ``root``. ``before`` is called with the number
    of each batch whose figures have been written and that is not committed yet.
    """

    def run(chats: DataFrame, batch: int) -> None:
        apply_batch(chats, batch, root, prepare)
        if before:
            before(batch)

    writer = stream.writeStream.foreachBatch(run).option("checkpointLocation", f"{root}/checkpoint")
    writer = writer.trigger(availableNow=True) if seconds is None else writer.trigger(processingTime=f"{seconds} seconds")
    return writer.start()
