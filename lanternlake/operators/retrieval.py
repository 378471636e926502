"""Hybrid retrieval over batches of queries: BM25, exact vectors, fusion, boosts and parents."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.curation import intent, intent_factor
from ..functions.text import fold_ws, identifiers, token_set
from ..sources.work import small_table, work_table
from . import lexical

TOP_K, FUSED, FINAL = 30, 15, 5
RRF_K, WEIGHT = 60, 0.5
#: Tokens that a pair of sets must share among their first ones before the whole sets are compared.
SHARED = 3
#: Queries that are compared at a time, and rows that are scored together.
QUERY_BLOCK, TILE = 1024, 1024


def bm25_index(corpus: DataFrame) -> dict[str, DataFrame]:
    """The tables of an index of a corpus (idx, text), to be used at once or stored by ``store.install``."""
    return lexical.build(corpus)


def bm25_top(queries: DataFrame, corpus: DataFrame | None, k: int = TOP_K, index: dict[str, DataFrame] | None = None, block: int = QUERY_BLOCK) -> DataFrame:
    """(query_id, idx, bm25_score, bm25_rank): the ``k`` best positive scores, equal ones by idx.

    ``queries`` is (query_id, text); ``index`` holds the tables of ``bm25_index``, by default those of ``corpus``.
    Queries that share no term with the corpus have no rows.
    """
    return lexical.search(queries, index or bm25_index(corpus), k, block)


def _nearest(shared, k: int):
    def run(batches):
        ids, matrix = shared.value
        best = lexical.Best(len(ids), k, np.full(len(ids), -np.inf))
        every = np.arange(len(ids))
        for batch in batches:
            idx = batch.column(0).to_numpy()
            for at in range(0, len(idx), TILE):
                vectors = np.stack(batch.column(1).slice(at, TILE).to_numpy(zero_copy_only=False)).astype(np.float64)
                scores = np.round(vectors @ matrix.T, 6)
                best.offer(np.tile(every, len(scores)), scores.ravel(), np.repeat(idx[at : at + TILE], len(every)))
        best.merge()
        yield pa.RecordBatch.from_pydict({"query_id": ids.take(pa.array(best.query)), "idx": best.idx, "dense_score": best.score})

    return run


def dense_top(queries: DataFrame, vectors: DataFrame, k: int = TOP_K, block: int = QUERY_BLOCK) -> DataFrame:
    """(query_id, idx, dense_score, dense_rank): the ``k`` largest inner products of each query.

    Blocks of ``block`` query vectors are broadcast in turn; each task keeps ``k`` candidates a query, so
    that pairs are never rows, and they are written before the next block is sent. Queries are (query_id, vector), the corpus is (idx, vector).
    """
    spark = vectors.sparkSession
    n = queries.count()
    blocks = max(1, -(-n // block))
    parts = []
    for b in range(blocks):
        mine = queries if blocks == 1 else queries.filter(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b)
        rows = sorted((r["query_id"], r["vector"]) for r in mine.collect())
        if len(rows):
            shared = spark.sparkContext.broadcast((pa.array([r[0] for r in rows], pa.int64()), np.array([r[1] for r in rows], np.float64)))
            found = vectors.select(F.col("idx").cast("long"), "vector").mapInArrow(_nearest(shared, k), "query_id long, idx long, dense_score double")
            parts.append(work_table(found, "dense-hits"))
            shared.unpersist()
    if not parts:
        return small_table(spark, "query_id long, idx long, dense_score double, dense_rank int")
    order = Window.partitionBy("query_id").orderBy(F.desc("dense_score"), "idx")
    return reduce(DataFrame.union, parts).withColumn("dense_rank", F.row_number().over(order)).filter(F.col("dense_rank") <= k)


def confident(dense: DataFrame, sparse: DataFrame, min_dense: float = 0.83, min_bm25: float = 20.0) -> DataFrame:
    """Queries whose best vector or best lexical hit reaches its threshold, with both best scores."""
    a = dense.filter("dense_rank = 1").select("query_id", "dense_score")
    b = sparse.filter("bm25_rank = 1").select("query_id", "bm25_score")
    both = a.join(b, "query_id", "full_outer")
    best = lambda c: F.coalesce(c, F.lit(0.0))
    passed = (best("dense_score") >= min_dense) | (best("bm25_score") >= min_bm25)
    return both.select("query_id", best("dense_score").alias("best_dense"), best("bm25_score").alias("best_bm25"), passed.alias("passed"))


def fuse(dense: DataFrame, sparse: DataFrame, weight: float = WEIGHT, k: int = RRF_K) -> DataFrame:
    """Weighted reciprocal rank fusion: every hit of either list with its combined score and rank."""
    both = dense.join(sparse, ["query_id", "idx"], "full_outer")
    share = lambda rank: F.coalesce(F.lit(weight) / (k + F.col(rank)), F.lit(0.0))
    out = both.withColumn("combined_score", F.round(share("dense_rank") + share("bm25_rank"), 12)).withColumn(
        "matched_both", F.col("dense_rank").isNotNull() & F.col("bm25_rank").isNotNull()
    )
    order = Window.partitionBy("query_id").orderBy(F.desc("combined_score"), F.asc_nulls_last("dense_rank"), F.asc_nulls_last("bm25_rank"))
    return out.withColumn("fused_rank", F.row_number().over(order))


def boost(fused: DataFrame, queries: DataFrame, corpus: DataFrame, cut: int = FUSED) -> DataFrame:
    """Fused hits with rule factor and reasons, re-ranked, the best ``cut`` of each query.

    ``corpus`` is (idx, source, heading, section_path, text). The factor is the product of intent,
    identifiers, phrase and heading rules between 0.80 and 1.45. Texts are folded once per hit.
    """
    q = queries.select(
        "query_id", F.col("text").alias("query"), fold_ws("text").alias("q"), F.lower("text").alias("q_lower")
    ).withColumns({"wanted": identifiers(F.col("query"), F.col("q_lower")), "asked": intent(F.col("q")), "q_tokens": token_set(F.col("q"))})
    # Written, so that Spark broadcasts questions only where they are small.
    q = work_table(q, "boost-questions")
    c = corpus.select("idx", "source", "heading", "section_path", F.concat_ws(" ", "source", "heading", "section_path", "text").alias("all"), "text")
    hits = fused.join(c, "idx").join(q, "query_id")
    hits = hits.withColumns({"s": fold_ws("all"), "h": token_set(fold_ws(F.concat_ws(" ", "heading", "section_path")))})
    matched = F.filter("wanted", lambda x: F.contains(F.col("s"), x))
    every = (F.size("wanted") > 0) & (F.size(matched) == F.size("wanted"))
    some = ~every & (F.size(matched) > 0)
    words = F.size(F.split("q", " "))
    phrase = words.between(3, 24) & F.contains(F.col("s"), F.col("q"))
    heading = (F.size("q_tokens") > 0) & (F.size(F.array_intersect("q_tokens", "h")) / F.size("q_tokens") >= 0.5)
    factor = (
        intent_factor(F.col("asked"), F.col("s"))
        * F.when(every, 1.25).when(some, 1.10).otherwise(1.0)
        * F.when(phrase, 1.15).otherwise(1.0)
        * F.when(heading, 1.08).otherwise(1.0)
    )
    reasons = F.array_compact(
        F.array(F.when(every, "all_identifiers"), F.when(some, "some_identifiers"), F.when(phrase, "exact_phrase"), F.when(heading, "heading_match"))
    )
    out = hits.withColumn("rule_factor", F.least(F.greatest(factor, F.lit(0.80)), F.lit(1.45))).withColumn("boost_reasons", reasons)
    out = out.withColumn("combined_score", F.round(F.col("combined_score") * F.col("rule_factor"), 12))
    order = Window.partitionBy("query_id").orderBy(F.desc("combined_score"), "fused_rank")
    out = out.withColumn("boost_rank", F.row_number().over(order)).filter(F.col("boost_rank") <= cut)
    return out.drop("s", "h", "all", "query", "q", "q_lower", "wanted", "asked", "q_tokens")


def roll_up(children: DataFrame) -> DataFrame:
    """Children (query_id, parent_id, rank, combined_score, source, …) as parents.

    A child without a parent is its own, named after its source and rank. A parent has the best score times
    1 + 0.10 ln(1 + min(n - 1, 3)) and all other columns of its best child.
    """
    own = F.concat(F.coalesce("source", F.lit("")), F.lit("::rank-"), F.col("rank").cast("string"))
    named = children.withColumn("parent_id", F.coalesce(F.nullif(F.col("parent_id").cast("string"), F.lit("")), own))
    carried = [c for c in children.columns if c not in ("query_id", "parent_id", "rank", "combined_score")]
    p = named.groupBy("query_id", "parent_id").agg(
        F.max("combined_score").alias("best"), F.min("rank").alias("best_rank"), F.count("*").alias("matched"), *(F.min_by(c, "rank").alias(c) for c in carried)
    )
    score = F.col("best") * (1 + 0.10 * F.log1p(F.least(F.col("matched") - 1, F.lit(3))))
    p = p.withColumn("combined_score", F.round(score, 12))
    order = Window.partitionBy("query_id").orderBy(F.desc("combined_score"), "best_rank")
    return p.withColumn("parent_rank", F.row_number().over(order))


def set_classes(sets: DataFrame) -> DataFrame:
    """(id, class_id) of all ids in ``sets`` (id, tokens): ids with equal sets share the smallest of them."""
    keyed = sets.select("id", F.xxhash64(F.array_sort("tokens")).alias("h"), F.size("tokens").alias("n"), F.hash(F.array_sort("tokens")).alias("g"))
    least = keyed.groupBy("h", "n", "g").agg(F.min("id").alias("class_id"))
    return keyed.join(least, ["h", "n", "g"]).select("id", "class_id")


def similar_sets(sets: DataFrame, threshold: float = 0.78) -> DataFrame:
    """Pairs (left, right, jaccard) of ids in ``sets`` (id, tokens) at a Jaccard similarity of ``threshold``.

    Ids with equal sets are one class, named by its smallest id; pairs are between classes. Exact
    prefix filter: tokens are ordered from rare to frequent, and two sets that similar share one of the
    first |x| - ceil(t |x|) + 1 tokens of both; places and number of the shared ones, sizes and at last the whole sets are checked.
    """
    # Written, so that texts are cut into tokens once; an empty set is in no row of ``wide``, where a filter would cut them again.
    classes = work_table(sets.groupBy(F.array_sort("tokens").alias("tokens")).agg(F.min("id").alias("id")), "set-classes")
    wide = classes.select("id", F.explode("tokens").alias("token"))
    # Tokens are numbers from here on, in order from rare to frequent, which take a part of the bytes of words in shuffles.
    ranks = wide.groupBy("token").agg(F.count("*").alias("df")).orderBy("df", "token").select("token", F.monotonically_increasing_id().alias("rank"))
    ranked = wide.join(work_table(ranks, "token-ranks"), "token").groupBy("id").agg(F.sort_array(F.collect_list("rank")).alias("tokens"))
    ordered = ranked.select("id", "tokens", F.size("tokens").alias("n"))
    ordered = work_table(ordered, "token-sets")
    keep = F.col("n") - F.ceil(F.col("n") * threshold - 1e-9) + 1
    prefix = ordered.select("id", "n", F.posexplode(F.slice("tokens", 1, keep.cast("int"))).alias("p", "token"))
    a, b = prefix.alias("a"), prefix.alias("b")
    near = F.least("a.n", "b.n") >= F.lit(threshold) * F.greatest("a.n", "b.n") - 1e-9
    # Sets that share ``need`` tokens share ``least`` of the first n - need + least of either, so a pair meets only on
    # tokens that stand early enough in both for their two sizes, and goes unless it meets on as many.
    need = F.ceil((F.col("a.n") + F.col("b.n")) * (threshold / (1 + threshold)) - 1e-9)
    outside = F.ceil(F.greatest("a.n", "b.n") * threshold - 1e-9) - 1
    least = F.greatest(F.lit(1), F.least(F.lit(SHARED), need - outside))
    early = (F.col("a.p") < F.col("a.n") - need + least) & (F.col("b.p") < F.col("b.n") - need + least)
    pairs = a.join(b, (F.col("a.token") == F.col("b.token")) & (F.col("a.id") < F.col("b.id")) & near & early)
    pairs = pairs.groupBy(F.col("a.id").alias("left"), F.col("b.id").alias("right"), least.alias("least")).agg(F.count("*").alias("c")).filter("c >= least").select("left", "right")
    x = ordered.select(F.col("id").alias("left"), F.col("tokens").alias("x"))
    y = ordered.select(F.col("id").alias("right"), F.col("tokens").alias("y"))
    common = F.size(F.array_intersect("x", "y"))
    jaccard = common / (F.size("x") + F.size("y") - common)
    return pairs.join(x, "left").join(y, "right").select("left", "right", jaccard.alias("jaccard")).filter(F.col("jaccard") >= threshold)
