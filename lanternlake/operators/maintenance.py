"""A lexical index that is kept up to date by difference: segments, tombstones and one commit for each batch."""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import store
from ..sources.work import small_table, work_table, write_table
from . import lexical

#: Blocks of a segment are numbered below this, above those of the segments before.
PER_SEGMENT = 1 << 52
EMPTY = {"segments": [], "tombstones": [], "words": [], "documents": 0, "length": 0}


def _state(root: str, version: str | None = None) -> dict:
    return store.read_note(root, version) or dict(EMPTY)


def _united(spark: SparkSession, paths: list[str], schema: str) -> DataFrame:
    return spark.read.schema(schema).parquet(*paths) if paths else small_table(spark, schema)


def _documents(batches):
    """Documents (idx, size, sign, terms, tf) from the blocks that hold them; those in ``wanted``, if there is such a column."""
    for batch in batches:
        out = []
        column = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
        for i in range(batch.num_rows):
            idx, size, held, docs, tf = (column[c][i].values.to_numpy() for c in ("idx", "size", "held", "docs", "tf"))
            terms = column["terms"][i].values
            which = np.repeat(np.arange(len(held)), held)
            order = np.lexsort((which, docs))
            kept = np.isin(idx, column["wanted"][i].values.to_numpy()) if "wanted" in column else np.ones(len(idx), bool)
            cut = np.searchsorted(docs[order], np.arange(len(idx) + 1))
            for d in np.flatnonzero(kept).tolist():
                own = order[cut[d] : cut[d + 1]]
                names, n = terms.take(pa.array(which[own])), tf[own]
                sign = names[int(np.lexsort((np.arange(len(n)), -n))[0])].as_py() if len(n) else None
                out.append((int(idx[d]), int(size[d]), sign, names.to_pylist(), n.tolist()))
        kinds = (pa.int64(), pa.int32(), pa.string(), pa.list_(pa.string()), pa.list_(pa.int32()))
        yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*out) if out else [[]] * 5, kinds)], ["idx", "size", "sign", "terms", "tf"])


DOCUMENTS = "idx long, size int, sign string, terms array<string>, tf array<int>"
WORDS, TOMBSTONES = "token string, df long", "doc_id long, block long, gone array<long>, before long"


def apply(root: str, rows: DataFrame, removed: DataFrame | None = None) -> str:
    """Add ``rows`` (idx, doc_id, text, …) and remove the documents ``removed`` (doc_id) in one commit; returns its version.

    A document whose rows are added replaces what the index holds of it. New rows become a segment. Removed rows
    stay in their segments and are named by tombstones; their terms and sizes are taken from the few blocks that hold them and
    are subtracted, so the work of a batch follows the batch and not the index. Nothing is visible before the
    last step, which points to the new version; a failed batch leaves the index as it was.
    """
    spark = rows.sparkSession
    state = _state(root)
    number = len(state["segments"])
    name = f"{root}/segments/{number:06d}-{uuid.uuid4().hex}"
    rows.write.parquet(f"{name}/rows")
    rows = spark.read.parquet(f"{name}/rows")
    blocks = lexical.block_table(rows.select("idx", "text")).withColumn("block", F.col("block") + number * PER_SEGMENT)
    write_table(blocks, f"{name}/blocks")
    blocks = spark.read.schema(lexical.BLOCKS).parquet(f"{name}/blocks")
    more = lexical.totals(blocks).first()
    words = lexical.word_table(blocks)
    ids = rows.select(F.col("doc_id").cast("long").alias("doc_id"))
    if removed is not None:
        ids = ids.union(removed.select(F.col("doc_id").cast("long")))
    ids = work_table(ids.distinct(), "index-replaced")
    fewer = {"documents": 0, "length": 0}
    if number:
        held = live(spark, root).select("idx", "doc_id", "segment").join(ids, "doc_id", "left_semi")
        old = _united(spark, [f"{s}/blocks" for s in state["segments"]], lexical.BLOCKS)
        places = old.select("block", F.explode("idx").alias("idx"), F.floor(F.col("block") / PER_SEGMENT).alias("segment"))
        gone = work_table(places.join(held, ["idx", "segment"]).select("doc_id", "block", "idx"), "index-gone")
        stones = gone.groupBy("block", "doc_id").agg(F.collect_list("idx").alias("gone")).withColumn("before", F.lit(number).cast("long"))
        stones.select("doc_id", "block", "gone", "before").write.parquet(f"{name}/tombstones")
        wanted = gone.groupBy("block").agg(F.collect_list("idx").alias("wanted"))
        lost = work_table(old.join(wanted, "block").select("idx", "size", "held", "docs", "tf", "terms", "wanted").mapInArrow(_documents, DOCUMENTS), "index-lost")
        fewer = lost.agg(F.count("*").alias("documents"), F.coalesce(F.sum("size"), F.lit(0)).alias("length")).first()
        less = lost.select(F.explode("terms").alias("token")).groupBy("token").agg((-F.count("*")).alias("df"))
        words = words.union(less).groupBy("token").agg(F.sum("df").alias("df")).filter("df <> 0")
    words.write.parquet(f"{name}/words")
    return store.note(root, {
        "segments": [*state["segments"], name],
        "tombstones": [*state["tombstones"], *([f"{name}/tombstones"] if number else [])],
        "words": [*state["words"], f"{name}/words"],
        "documents": state["documents"] + more["documents"] - fewer["documents"],
        "length": state["length"] + more["length"] - fewer["length"],
    })


def live(spark: SparkSession, root: str, version: str | None = None) -> DataFrame:
    """All rows of the index with the segment that holds them, without those that were removed later."""
    state = _state(root, version)
    parts = [spark.read.parquet(f"{s}/rows").withColumn("segment", F.lit(i).cast("long")) for i, s in enumerate(state["segments"])]
    if not parts:
        return small_table(spark, "idx long, doc_id long, text string, segment long")
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    stones = _united(spark, state["tombstones"], TOMBSTONES).groupBy(F.col("doc_id").alias("_doc")).agg(F.max("before").alias("_before"))
    return out.join(stones, (F.col("doc_id") == F.col("_doc")) & (F.col("segment") < F.col("_before")), "left_anti")


def load(spark: SparkSession, root: str, version: str | None = None) -> dict[str, DataFrame]:
    """The index as ``lexical.search`` takes it: blocks with the removed rows named, counts added up."""
    state = _state(root, version)
    blocks = _united(spark, [f"{s}/blocks" for s in state["segments"]], lexical.BLOCKS)
    stones = _united(spark, state["tombstones"], TOMBSTONES).groupBy("block").agg(F.flatten(F.collect_list("gone")).alias("gone"))
    words = _united(spark, state["words"], WORDS).groupBy("token").agg(F.sum("df").alias("df")).filter("df > 0")
    whole = small_table(spark, "documents long, length long", state["documents"], state["length"])
    return {"blocks": blocks.join(stones, "block", "left"), "words": words, "totals": whole}


def compact(spark: SparkSession, root: str) -> str:
    """Lay all live rows out anew as one segment without tombstones, from the index alone; one commit."""
    state = _state(root)
    name = f"{root}/segments/000000-{uuid.uuid4().hex}"
    live(spark, root).drop("segment").write.parquet(f"{name}/rows")
    kept = load(spark, root)["blocks"]
    # A block without removed rows keeps all of its documents.
    wanted = F.when(F.col("gone").isNull(), F.col("idx")).otherwise(F.array_except("idx", "gone"))
    documents = kept.select("idx", "size", "held", "docs", "tf", "terms", wanted.alias("wanted")).mapInArrow(_documents, DOCUMENTS)
    write_table(lexical.laid_out(work_table(documents, "index-documents")), f"{name}/blocks")
    blocks = spark.read.schema(lexical.BLOCKS).parquet(f"{name}/blocks")
    lexical.word_table(blocks).write.parquet(f"{name}/words")
    return store.note(root, {"segments": [name], "tombstones": [], "words": [f"{name}/words"], "documents": state["documents"], "length": state["length"]})
