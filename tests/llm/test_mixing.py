import re

import numpy as np
from pyspark.sql import functions as F

from lanternlake.llm import mixing


def table(spark):
    rng = np.random.default_rng(1)
    rows = [(i, " ".join(["w"] * int(rng.integers(1, 60))), ["b", "a", "Z", None, "é"][i % 5]) for i in range(900)]
    rows += [(1000, None, "a"), (1001, "", "b"), (1002, "only", "tiny"), (1003, None, "void"), (5, rows[5][1], "b"), (5, rows[5][1], "b")]
    return rows, spark.createDataFrame(rows, "doc_id long, text string, source string")


def brute_targets(sizes, weights=mixing.WEIGHTS, uses=3):
    """Words wanted of each source, one round of resharing after the other."""
    total, want, free = float(sum(sizes)), [0.0] * len(sizes), set(range(len(sizes)))
    weight = [weights[i % len(weights)] for i in range(len(sizes))]
    while free and total > 0:
        share = total / sum(weight[i] for i in free)
        full = [i for i in free if share * weight[i] >= uses * sizes[i]]
        for i in full or list(free):
            want[i] = float(uses * sizes[i]) if full else share * weight[i]
            total -= want[i] if full else 0
            free.remove(i)
        if not full:
            break
    return want


def test_targets(spark):
    rng = np.random.default_rng(2)
    cases = [[100, 100, 100], [10, 1000], [0, 0], [], [5, 0, 7, 9000, 3], rng.integers(0, 10_000, 400).tolist(), (10 ** rng.uniform(0, 7, 300)).astype(int).tolist()]
    for sizes in cases:
        df = spark.createDataFrame([(i, int(n)) for i, n in enumerate(sizes)], "sid long, words long")
        got = [r.target for r in mixing.with_targets(df).orderBy("sid").collect()]
        assert np.allclose(got, brute_targets(sizes), rtol=1e-9), sizes


def test_numbering(spark):
    names = [None, "", "a", "B", "é", "\U0001f600", "\uffee", *(f"n{i}" for i in range(300))]
    df = spark.createDataFrame([(n,) for n in names], "source string").repartition(7)
    got = mixing.numbered(df, [F.col("source").isNull(), "source"], "t").orderBy("sid").collect()
    assert [r.source for r in got] == [*sorted(n for n in names if n is not None), None] and [r.sid for r in got] == list(range(len(names)))


def test_fill():
    assert mixing.fill(np.array([100]), np.array([90]), 3625.0).tolist() == [36]
    assert mixing.fill(np.array([100]), np.array([90]), 3680.0).tolist() == [37]
    assert mixing.fill(np.array([7, 0, 3]), np.array([1, 5, 2]), 10.0).tolist() == [1, 0, 1]
    assert mixing.fill(np.array([50]), np.array([1]), 20.0).tolist() == [0] and mixing.fill(np.array([50]), np.array([1]), 30.0).tolist() == [1]


def test_splitting_tree():
    blocks = np.array([5, 0, 300, 20, 75])
    draws = np.array([mixing.split_quota(blocks, 100, np.random.default_rng(i)) for i in range(400)])
    assert (draws.sum(axis=1) == 100).all() and (draws <= blocks).all()
    assert np.allclose(draws.mean(axis=0), blocks / 4, atol=0.6)


def test_contract(spark, monkeypatch):
    monkeypatch.setattr(mixing, "SHARD_WORDS", 4000)
    monkeypatch.setattr(mixing, "GROUP_WORDS", 1000)
    rows, df = table(spark)
    df = df.withColumn("size", F.lit(1))
    got = mixing.op9(df).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, mixing.op9(df.repartition(5)).collect()))
    assert len(got) == len(rows) and all(r.taken <= 3 * r.size for r in got)
    sizes = {}
    for _, text, source in rows:
        sizes[source] = sizes.get(source, 0) + len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    want = dict(zip(order, brute_targets([sizes[s] for s in order])))
    source_of = {(i, t): s for i, t, s in rows}
    taken = {}
    for (i, t), s in source_of.items():
        mine = [r for r in got if r.doc_id == i]
        assert all(r.source_size == sizes[s] and abs(r.target - want[s]) < 1e-6 for r in mine)
        taken[s] = taken.get(s, 0) + sum(r.taken for r in mine)
    for s in order:
        assert abs(taken[s] - want[s]) <= max(2, 0.03 * want[s]), s


def test_corpus(spark):
    rows, df = table(spark)
    mixed = mixing.mixed_corpus(df)
    assert mixed.columns == [*df.columns, "mix_shard", "mix_copy"]
    words = sum(len((r.text or "").split()) for r in mixed.collect())
    assert words == sum(r.taken for r in mixing.op9(df).collect())
    assert mixing.op9(df.limit(0)).count() == 0 and mixing.mixed_corpus(df.limit(0)).count() == 0


def test_a_row_repeated_a_thousand_times(spark):
    rows = [(1, "w " * 100, "a")] * 1000 + [(2 + i, "v " * (i % 50), "b") for i in range(800)] + [(5000 + i, "u " * 10, "c") for i in range(90)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("mix_copy", F.lit("clash")).repartition(6)
    got = mixing.op9(df).collect()
    assert len(got) == len(rows) and all(r.taken in (0, r.size, 2 * r.size, 3 * r.size) for r in got)
    sizes = [100_000, sum(i % 50 for i in range(800)), 900]
    want = brute_targets(sizes)
    for lo, hi, target, size in zip((1, 2, 5000), (1, 801, 5089), want, sizes):
        mine = [r for r in got if lo <= r.doc_id <= hi]
        assert all(abs(r.target - target) < 1e-6 and r.source_size == size for r in mine)
        assert abs(sum(r.taken for r in mine) - target) <= max(50, 0.002 * target)
    mixed = mixing.mixed_corpus(df)
    counted = mixed.groupBy("doc_id").count().collect()
    assert {r.doc_id: r["count"] for r in counted if r.doc_id == 1} == {1: sum(r.taken for r in got if r.doc_id == 1) // 100}
    assert mixed.schema["mix_copy"].dataType.simpleString() == "int" and mixed.columns == ["doc_id", "text", "source", "mix_shard", "mix_copy"]


def test_odd_rows(spark):
    rows = [(None, None, None), (None, None, None), (1, "", "a"), (2, "x " * 300_000, "a"), (3, None, "b")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("size", F.lit("clash")).withColumn("m", F.create_map(F.lit("k"), F.lit(1)))
    got = mixing.op9(df).collect()
    assert sorted((r.doc_id or 0, r["size"], r.source_size) for r in got) == [(0, 0, 0), (0, 0, 0), (1, 0, 300_000), (2, 300_000, 300_000), (3, 0, 0)]
    assert sum(r.taken for r in got) == 300_000
    assert mixing.mixed_corpus(df.withColumn("a.b", F.lit(1))).filter("doc_id = 2").count() == 1
