"""Mixing sources to target weights through a multivariate-hypergeometric splitting tree."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import WORD, all_columns, materialise, row_key

WEIGHTS = (5.0, 2.0, 1.0)
#: A source is used at most so many times.
MAX_USES = 3
#: Output shards: one for about so many words. The tree of a source ends in groups of about GROUP_WORDS,
#: each of which belongs to one output shard or to a run of them; both are at most MAX_PARTS. A document counts
#: as ten words more there, so that many empty ones are dealt too.
SHARD_WORDS = 1_000_000
GROUP_WORDS = 100_000
MAX_PARTS = 1 << 18
#: Words in a block, the unit of quotas; a source has at most 2**28 blocks.
BLOCK_WORDS = 16
SEED = 7


def numbered(df: DataFrame, order: list, name: str) -> DataFrame:
    """``df`` written and read again with its place ``sid`` (0, 1, ...) in a total order.

    Ranges are sorted apart; only their row counts reach the driver.
    """
    placed = materialise(df.orderBy(*order).withColumn("_at", F.monotonically_increasing_id()), name)
    part = F.shiftright("_at", 33)
    counts = sorted((r[0], r["count"]) for r in placed.groupBy(part).count().collect())
    before = np.cumsum([0] + [n for _, n in counts])
    offsets = df.sparkSession.createDataFrame([(p, int(b)) for (p, _), b in zip(counts, before)], "_part long, _before long")
    joined = placed.withColumn("_part", part).join(offsets, "_part")
    return joined.withColumn("sid", F.col("_before") + F.col("_at").bitwiseAND((1 << 33) - 1)).drop("_part", "_before", "_at")


def with_targets(sources: DataFrame, weights=WEIGHTS, max_uses: float = MAX_USES) -> DataFrame:
    """``sources`` (sid, words) with their ``target``: by weight, none above ``max_uses`` times the words.

    A target is the lesser of that cap and level times weight. The level rises while the excess of
    capped sources is shared by the others; each turn is one aggregate.
    """
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.col("sid") % len(weights) + 1).cast("int"))
    cap = F.col("words") * float(max_uses)
    total = float(sources.agg(F.sum("words")).first()[0] or 0)
    level, capped = 0.0, -1
    while total:
        full = (F.lit(level) * weight >= cap) if level else F.lit(False)
        row = sources.agg(
            F.count(F.when(full, 1)).alias("n"), F.sum(F.when(full, cap).otherwise(0.0)).alias("used"), F.sum(F.when(~full, weight)).alias("free")
        ).first()
        if row["n"] == capped or not row["free"]:
            break
        level, capped = (total - row["used"]) / row["free"], row["n"]
    return sources.withColumn("target", F.least(F.lit(level) * weight, cap))


def split_quota(blocks: np.ndarray, quota: int, rng: np.random.Generator) -> np.ndarray:
    """Blocks drawn of each part when ``quota`` of all ``blocks`` are drawn without replacement.

    A node of the tree splits its quota between its two halves by one hypergeometric draw.
    """
    out = np.zeros(len(blocks), np.int64)
    before = np.concatenate(([0], np.cumsum(blocks)))
    nodes = [(0, len(blocks), int(min(quota, before[-1])))]
    while nodes:
        lo, hi, wanted = nodes.pop()
        if hi - lo == 1:
            out[lo] = wanted
            continue
        mid = (lo + hi) // 2
        left, right = int(before[mid] - before[lo]), int(before[hi] - before[mid])
        drawn = int(rng.hypergeometric(left, right, wanted)) if wanted else 0
        nodes += [(lo, mid, drawn), (mid, hi, wanted - drawn)]
    return out


def _quotas(seed: int):
    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("part")
        source, rest = int(group["sid"].iloc[0]), float(group["rest"].iloc[0])
        words = group["words"].to_numpy(np.int64)
        unit = max(BLOCK_WORDS, -(-int(words.sum()) // (1 << 28)))
        blocks = -(-words // unit)
        drawn = split_quota(blocks, round(rest / max(1, words.sum()) * blocks.sum()), np.random.default_rng([seed, source]))
        quota = words * (drawn / np.maximum(blocks, 1))
        return pd.DataFrame({"sid": group["sid"], "part": group["part"], "quota": quota})

    return run


def fill(words: np.ndarray, rows: np.ndarray, quota: float) -> np.ndarray:
    """How many of the equal ``rows`` of each document, in permuted order, make up a quota of words.

    As many as still fit are taken; at last one row is moved, in or out, if that brings the words nearer.
    """
    taken, used = np.zeros(len(words), np.int64), 0
    for i, (w, n) in enumerate(zip(words.tolist(), rows.tolist())):
        if w and used + w <= quota:
            taken[i] = min(n, int((quota - used) // w))
            used += w * int(taken[i])
    if not len(words):
        return taken
    for change in (1, -1):
        may = (words > 0) & (taken < rows if change > 0 else taken > 0)
        off = np.where(may, np.abs(quota - used - change * words), np.inf)
        nearest = int(off.argmin())
        if off[nearest] < abs(quota - used):
            taken[nearest] += change
            break
    return taken


def _draw(part: pa.Table) -> pa.Table:
    part = part.sort_by([("turn", "ascending"), ("_k1", "ascending"), ("_k2", "ascending")])
    taken = fill(part.column("size").to_numpy(), part.column("n").to_numpy(), part.column("quota")[0].as_py())
    return part.drop_columns(["quota"]).append_column("extra", pa.array(taken))


def _types(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)


def plan_mix(docs: DataFrame, weights=WEIGHTS, max_uses: int = MAX_USES, seed: int = SEED) -> DataFrame:
    """Content key, doc_id, size, source_size, target, shard, whole, extra and shuffle key of every distinct row.

    ``n`` counts rows that are equal in all columns: each is used ``whole`` times, and ``extra`` of them once
    more. A null text has size 0, a null source comes last, an empty table gives no rows. Every source is
    used whole ``target // source_size`` times; the rest of its target is a quota of blocks that the tree
    splits among runs of output shards, down to parts of about GROUP_WORDS of the source. A part takes
    documents in permuted order up to its quota, then moves the one row that brings its words nearest, and
    deals them to its shards. Documents are whole, so blocks are units of quotas only. The draws depend
    on the seed and the rows only.
    """
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", size.alias("size"), *row_key(*all_columns(docs)))
    rows = materialise(
        rows.groupBy("_k1", "_k2").agg(
            F.first("doc_id").alias("doc_id"), F.first("source").alias("source"), F.first("size").alias("size"), F.count("*").alias("n")
        ),
        "mix-sizes",
    )
    by_source = rows.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("words"), F.count("*").alias("rows"))
    listed = materialise(with_targets(numbered(by_source, [F.col("source").isNull(), "source"], "mix-source-order"), weights, max_uses), "mix-sources")
    total = listed.agg(F.sum("words")).first()[0] or 0
    shards = min(MAX_PARTS, max(1, -(-total // SHARD_WORDS)))
    whole = F.when(F.col("words") > 0, F.least(F.lit(max_uses), F.floor(F.col("target") / F.col("words")))).otherwise(0).cast("int")
    parts = F.least(F.lit(MAX_PARTS), F.greatest(F.lit(1), F.ceil((F.col("words") + 10 * F.col("rows")) / GROUP_WORDS))).cast("int")
    sources = listed.select(
        "sid", F.col("source").alias("_source"), F.col("words").alias("source_size"), "target", whole.alias("whole"),
        F.greatest(F.lit(0.0), F.col("target") - whole * F.col("words")).alias("rest"), parts.alias("parts"),
    )
    placed = rows.join(sources, rows["source"].eqNullSafe(sources["_source"])).select(
        "_k1", "_k2", "doc_id", "size", "n", "sid", "source_size", "target", "whole", "rest", "parts",
        F.pmod(F.xxhash64("_k1", "_k2", F.lit(seed)), F.col("parts")).cast("int").alias("part"),
        F.xxhash64("_k2", "_k1", F.lit(seed + 1)).alias("turn"),
    )
    # A part covers this run of output shards, within which a document has a place by chance.
    place = F.pmod(F.xxhash64("turn"), F.lit(1 << 30)) / (1 << 30)
    shard = F.floor((F.col("part") + place) * shards / F.col("parts")).cast("int")
    held = placed.filter("rest > 0").groupBy("sid", "part").agg(
        F.sum(F.col("size") * F.col("n")).alias("words"), F.first("rest").alias("rest")
    )
    quotas = materialise(
        held.groupBy("sid").applyInPandas(_quotas(seed), "sid long, part int, quota double"), "mix-quotas"
    )
    drawn = placed.join(quotas, ["sid", "part"])
    drawn = drawn.groupBy("sid", "part").applyInArrow(_draw, f"{_types(drawn.drop('quota'))}, extra long")
    resting = placed.join(quotas, ["sid", "part"], "left_anti").withColumn("extra", F.lit(0).cast("long"))
    columns = [*placed.columns, "extra"]
    return drawn.select(columns).union(resting.select(columns)).select(
        "_k1", "_k2", "doc_id", "size", "n", "source_size", "target", shard.alias("shard"), "turn", "whole", "extra"
    )


def op9(docs: DataFrame) -> DataFrame:
    """The columns of the mixing contract."""
    plan = plan_mix(docs).withColumn("i", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))))
    copies = F.col("whole") + (F.col("i") <= F.col("extra")).cast("int")
    return plan.select("doc_id", "size", "source_size", "target", (F.col("size") * copies).alias("taken"))


def mixed_corpus(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """The mix: a row for each copy drawn, with the columns of ``docs`` and mix_shard and mix_copy.

    mix_copy numbers the copies of rows that are equal in all columns. Columns of ``docs`` with the names
    mix_shard and mix_copy are replaced. Rows of a shard stand together in shuffled order; a shard is a
    few MB, so sorting it is local.
    """
    copies = (F.col("whole") * F.col("n") + F.col("extra")).cast("int")
    plan = plan_mix(docs, seed=seed).select("_k1", "_k2", "shard", copies.alias("copies")).filter("copies > 0")
    # Equal rows become one before the shuffle; the join is on the keys that they are grouped by.
    keyed = docs.select(F.struct("*").alias("_row"), *row_key(*all_columns(docs))).groupBy("_k1", "_k2").agg(F.first("_row").alias("_row"))
    drawn = keyed.join(plan, ["_k1", "_k2"]).withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    drawn = drawn.repartition(F.col("shard")).sortWithinPartitions(
        "shard", F.xxhash64("_k1", "_k2", "copy", F.lit(seed + 2))
    )
    names = [c for c in docs.columns if c not in ("mix_shard", "mix_copy")]
    return drawn.select(
        *(F.col("_row").getField(c).alias(c) for c in names), F.col("shard").alias("mix_shard"), F.col("copy").alias("mix_copy")
    )
