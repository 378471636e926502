import numpy as np
import pytest
from pyspark.sql import functions as F

from lanternlake.operators import lexical, maintenance, retrieval
from lanternlake.sources import store


def rows_of(spark, items):
    return spark.createDataFrame([(i, i // 3, t, "x") for i, t in items], "idx long, doc_id long, text string, source string")


def same_as_rebuilt(spark, root, items, asked):
    index = maintenance.load(spark, root)
    new = lexical.build(spark.createDataFrame(items, "idx long, text string"))
    assert sorted(map(tuple, index["words"].collect())) == sorted(map(tuple, new["words"].collect()))
    assert tuple(index["totals"].first()) == tuple(new["totals"].first())
    got = sorted(map(tuple, retrieval.bm25_top(asked, None, 5, index=index).collect()))
    assert got == sorted(map(tuple, retrieval.bm25_top(asked, None, 5, index=new).collect())) and got
    assert sorted((r.idx, r.text) for r in maintenance.live(spark, root).collect()) == sorted(items)


def test_batches_equal_a_rebuild(spark, tmp_path):
    rng = np.random.default_rng(4)
    text = lambda: " ".join(f"w{x}" for x in rng.zipf(1.4, rng.integers(0, 30)) % 60)
    held = {i: text() for i in range(90)}
    asked = spark.createDataFrame([(i, held[i * 9] or "w1") for i in range(8)], "query_id long, text string")
    root = str(tmp_path)
    maintenance.apply(root, rows_of(spark, held.items()))
    first = store.current(root)
    more = {i: text() for i in range(120, 150)}
    maintenance.apply(root, rows_of(spark, more.items()), spark.createDataFrame([(2,), (5,), (77,)], "doc_id long"))
    held = {i: t for i, t in held.items() if i // 3 not in (2, 5)} | more
    same_as_rebuilt(spark, root, list(held.items()), asked)
    # A document that comes again replaces all its rows, also those that came before it was removed.
    again = {6: "w1 w2 back", 9: "w3", 120: "w1 w1 w1"}
    maintenance.apply(root, rows_of(spark, again.items()))
    held = {i: t for i, t in held.items() if i // 3 not in (2, 3, 40)} | again
    same_as_rebuilt(spark, root, list(held.items()), asked)
    maintenance.compact(spark, root)
    same_as_rebuilt(spark, root, list(held.items()), asked)
    assert len(store.read_note(root)["segments"]) == 1
    maintenance.apply(root, rows_of(spark, []), spark.createDataFrame([(3,)], "doc_id long"))
    held = {i: t for i, t in held.items() if i // 3 != 3}
    same_as_rebuilt(spark, root, list(held.items()), asked)
    # The first version is still there.
    store.point(root, first)
    assert maintenance.live(spark, root).count() == 90


def test_a_failed_batch_changes_nothing(spark, tmp_path, monkeypatch):
    root = str(tmp_path)
    maintenance.apply(root, rows_of(spark, [(0, "a1 b1"), (3, "b1 c1")]))
    before = store.current(root)
    monkeypatch.setattr(lexical, "word_table", lambda blocks: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        maintenance.apply(root, rows_of(spark, [(6, "d1")]))
    assert store.current(root) == before and maintenance.live(spark, root).count() == 2


def test_no_batch_runs_python_rdds(spark, tmp_path, monkeypatch):
    """The tasks of a list made into rows start Python workers of a second kind, which stay on the executors."""
    held = spark.createDataFrame([(i, i, f"a{i} b{i % 3} c1", "x") for i in range(9)], "idx long, doc_id long, text string, source string").localCheckpoint()
    gone, asked = spark.range(2).select(F.col("id").alias("doc_id")), spark.range(1).select(F.col("id").alias("query_id"), F.lit("b2 c1").alias("text"))
    monkeypatch.setattr(type(spark), "createDataFrame", lambda *a, **k: pytest.fail("rows from a list"))
    root = str(tmp_path)
    assert maintenance.live(spark, root).count() == 0
    maintenance.apply(root, held.filter("idx < 6"))
    maintenance.apply(root, held.filter("idx > 5"), gone)
    index = maintenance.load(spark, root)
    assert tuple(index["totals"].first()) == (7, 42) and index["totals"].schema["length"].dataType.simpleString() == "bigint"
    assert sorted(r.idx for r in retrieval.bm25_top(asked, None, 9, index=index).collect()) == [2, 3, 4, 5, 6, 7, 8]
