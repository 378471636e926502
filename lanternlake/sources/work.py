"""Intermediate tables in the folder that the driver and all executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; where the master is local and none is set, a temporary one for the session."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="lanternlake-")
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(folder)
    return re.sub(r"^file:/(?=[^/])", "file:///", folder)


#: Rows and bytes of an Arrow batch, and bytes of a Parquet row group: what a task holds at once outside of sorts and joins.
BATCH_ROWS, BATCH_BYTES, ROW_GROUP = 2048, 4 << 20, 16 << 20


def small_batches(spark: SparkSession) -> None:
    """Bound the Arrow batches of a session, which both sides of the pipe to Python hold; smaller ones stay as they are.

    Plans run after their query returns, so both settings stay for the session; they change no result.
    """
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if not re.fullmatch(r"\d+b?", spark.conf.get(name)) or not 0 < int(spark.conf.get(name).rstrip("b")) <= BATCH_BYTES:
        spark.conf.set(name, str(BATCH_BYTES))


def small_table(spark: SparkSession, schema: str, *values) -> DataFrame:
    """One row of ``values``, or none without them, from a range.

    ``createDataFrame`` of a list is an RDD in Python: its tasks start a daemon and workers of their own on
    every executor, beside those of Arrow, and these stay.
    """
    fields = StructType.fromDDL(schema).fields
    columns = zip(fields, values or [None] * len(fields), strict=True)
    return spark.range(0, 1 if values else 0, 1, 1).select(*(F.lit(v).cast(f.dataType).alias(f.name) for f, v in columns))


def write_table(df: DataFrame, path: str) -> None:
    """``df`` as Parquet in small row groups, as a reader decodes up to 4,096 rows of one at once, however wide they are.

    Columns are packed by zstd, which finds the repeats of texts and words that the default looks too near for.
    """
    small_batches(df.sparkSession)
    df.write.option("parquet.block.size", ROW_GROUP).option("compression", "zstd").parquet(path)


def work_table(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet and read again: lineage ends here, and plans know its true size."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    write_table(df, path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
