"""Connected components over an edge table, as Spark joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import shared_dir


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component) of every node in ``edges`` (a long, b long); component is the smallest node.

    Each round every node takes the smallest label among itself and its neighbours and then the label of
    its label, so that a component of diameter d ends after about log d rounds. Labels are checkpointed
    each round; only a count of changes reaches the driver.
    """
    spark = edges.sparkSession
    shared_dir(spark)
    links = (
        edges.filter("a <> b")
        .select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("e"))
        .select(F.col("e.a").alias("from"), F.col("e.b").alias("node"))
        .distinct()
        .checkpoint()
    )
    labels = links.groupBy("node").agg(F.min("from").alias("l"))
    labels = labels.select("node", F.least("node", "l").alias("label")).checkpoint()
    for _ in range(max_rounds):
        offered = (
            links.join(labels, "node")
            .groupBy(F.col("from").alias("node"))
            .agg(F.min("label").alias("offer"))
        )
        # What a node learns it also offers to the node that its label names.
        heard = labels.join(offered, "node").select("node", "label", F.least("label", "offer").alias("best"))
        hooked = (
            heard.select("node", "best")
            .union(heard.filter("best < label").select(F.col("label").alias("node"), "best"))
            .groupBy("node")
            .agg(F.min("best").alias("best"))
        )
        jump = hooked.select(F.col("node").alias("best"), F.col("best").alias("further"))
        new = (
            hooked.join(jump, "best", "left")
            .select("node", F.least("best", F.coalesce("further", "best")).alias("label"))
            .checkpoint()
        )
        changed = new.join(labels.withColumnRenamed("label", "old"), "node").filter("label <> old").limit(1).count()
        labels = new
        if not changed:
            return labels.select("node", F.col("label").alias("component"))
    raise RuntimeError("components did not settle")
