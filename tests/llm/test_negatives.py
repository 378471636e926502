import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lanternlake.llm import negatives
from lanternlake.llm.queries import table

SCHEMA = "vec_id long, embedding array<double>, label int, v string, rank int"


def brute(rows):
    """The contract by loops over all pairs; ``rows`` are (vec_id, embedding, label)."""
    kept = {}
    for i, x, label in rows:
        if i is None or x is None or label is None or any(c is None or not math.isfinite(c) for c in x):
            continue
        label = (label + 1) % 10 if i % 7 == 0 else label
        kept[i] = (label, [math.floor(256 * c) for c in x])
    out = set()
    for a, (label, x) in kept.items():
        if a % 100:
            continue
        scores = sorted((-sum(p * q for p, q in zip(x, y)), i, other) for i, (other, y) in kept.items() if i != a)
        for s, p, _ in [r for r in scores if r[2] == label][:5]:
            fits = [r for r in scores if r[2] != label and -80 * s <= -100 * r[0] <= -100 * s][:5]
            out |= {(a, p, rank, i, -s, -t) for rank, (t, i, _) in enumerate(fits, 1)}
    return out


def got(df):
    rows = [(r.anchor_id, r.positive_id, r["rank"], r.negative_id, r.positive_score, r.negative_score) for r in df.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def test_contract_matches_brute_force(spark, monkeypatch):
    monkeypatch.setattr(negatives, "TREE_ROWS", 128)
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(3, 8))
    rows = [(i, (centres[i % 3] + 0.2 * rng.normal(size=8)).tolist(), int(rng.integers(0, 3))) for i in range(700)]
    hot = [0.5] * 8  # one vector for a third of the rows
    rows += [(i, hot, i % 2) for i in range(700, 1050)]
    rows += [(2000, None, 1), (2100, [0.5] * 8, None), (2200, [float("nan")] * 8, 1), (2300, [None] + [0.1] * 7, 1)]
    rows += [(2400, [float("inf")] * 8, 1), (None, hot, 1), (2500, [0.0] * 8, 0), (2600, [-0.5] * 8, 1)]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)
    want = brute(rows)
    assert len(want) > 100
    assert got(negatives.op11(df.repartition(3))) == want
    few = negatives.hard_negatives(
        negatives.taking_part(df).withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))), block=4
    )
    assert got(few) == want


def test_small_tables(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert negatives.op11(empty).count() == 0
    one = spark.createDataFrame([(100, [1.0, 2.0], 1, "x", 1)], SCHEMA)
    assert negatives.op11(one).count() == 0
    # Repeated ids: the row with the smallest label and vector stays; unequal lengths are filled with zeros.
    rows = [(100, [1.0], 1), (100, [1.0], 1), (100, [3.0], 2), (1, [1.0, 5.0], 1), (2, [0.9], 3), (3, [], 1)]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)
    assert got(negatives.op11(df)) == {(100, 1, 1, 2, 256 * 256, 256 * 230)}


@pytest.mark.parametrize("leaf", [4, 64])
def test_trees_find_all_and_leave_rows_out(leaf):
    rng = np.random.default_rng(1)
    vectors = np.concatenate([rng.normal(c, 3, (400, 6)) for c in rng.normal(0, 300, (10, 6))]).astype(np.int64)
    ids, labels = rng.permutation(len(vectors)).astype(np.int64), rng.integers(0, 4, len(vectors))
    tree = negatives.Tree(ids, labels, vectors, leaf)
    queries = vectors[:40]
    norms = (queries.astype(float) ** 2).sum(axis=1)
    scores = queries @ vectors.T
    high = np.quantile(scores, 0.9, axis=1).astype(np.int64)
    found = negatives.Found(high // 2, high, labels[:40], False, ids[:40], 5)
    scored = tree.nearest(found, queries, norms, np.arange(40))
    want = set()
    for q in range(40):
        rows = [(-scores[q, j], ids[j]) for j in range(len(ids)) if labels[j] != labels[q] and high[q] // 2 <= scores[q, j] <= high[q]]
        want |= {(q, i, -s) for s, i in sorted(rows)[:5]}
    assert {tuple(r) for r in found.rows} == want
    assert scored < 0.7 * 40 * len(ids)


def test_huge_components_stay_exact():
    a = np.array([[2**31 - 1, -(2**31)]])
    assert negatives._exact(a, a)[0, 0] == (2**31 - 1) ** 2 + 2**62


def test_query_over_the_table(spark):
    folder = "/root/testdata/sf0.001"
    rows = [(r.vec_id, list(r.embedding), r.label) for r in table(spark, folder, "embeddings").collect()]
    assert got(negatives.op11(table(spark, folder, "embeddings"))) == brute(rows)
