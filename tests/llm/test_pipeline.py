import corpus_pipeline
from pyspark.sql import functions as F



def test_stages_and_run(spark, tmp_path):
    words = lambda i, n: " ".join(f"{'abcdefgh'[j % 8]}{i}x{j * 7 % 101}" for j in range(n))
    item = " ".join(f"bench{j}" for j in range(20))
    rows = [(i, words(i, 80), f"s{i % 3}") for i in range(30)]
    rows += [(100, words(0, 80), "s1"), (101, "too short", "s1"), (102, words(500, 60) + " " + item, "s0")]
    rows += [(103, words(600, 90) + " password=abcdef123", "s2"), (104, None, None), (3, words(3, 80), "s0")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("lang", F.lit("en"))
    docs = docs.withColumn("n_chars", F.length("text").cast("long"))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    stage = docs
    seen = []
    for name, f in corpus_pipeline.STAGES[:-1]:
        stage = f(spark, stage, str(tmp_path))
        assert stage.dtypes == docs.dtypes
        seen.append({r.doc_id for r in stage.collect()})
    assert 101 not in seen[0] and 104 not in seen[0] and 100 in seen[0]
    assert 100 not in seen[1] and 0 in seen[1]
    assert seen[1] - seen[2] == {102}
    assert seen[3] == seen[2] and "[SECRET]" in stage.filter("doc_id = 103").first()["text"]
    mixed = corpus_pipeline.run(spark, str(tmp_path))
    assert {r.doc_id for r in mixed.collect()} <= seen[3] and mixed.columns[: len(docs.columns)] == docs.columns


def test_stages_on_odd_tables(spark, tmp_path):
    """Empty tables, rows without anything, very long texts, repeated rows and clashing names, stage by stage."""
    item = " ".join(f"bench{j}" for j in range(20))
    spark.createDataFrame([(1, item), (2, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    schema = "doc_id long, text string, source string, _k1 int, kept string, spans long, n int"
    long_ = " ".join(f"w{j}" for j in range(60_000))
    good = " ".join(f"x{j}" for j in range(90))
    rows = [(None, None, None), (1, "", None), (2, None, "a"), (3, long_, "a"), (4, good, None), (4, good, None), (4, good, "b"), (None, good + " z", "a")]
    full = spark.createDataFrame([(*r, 1, "k", None, 2) for r in rows], schema)
    for docs in (full.limit(0), full.filter("text is null or text = ''"), full):
        stage, n = docs, docs.count()
        for name, f in corpus_pipeline.STAGES[:-1]:
            stage = f(spark, stage, str(tmp_path))
            assert stage.columns == docs.columns, name
            m = stage.count()
            assert m <= n, name
            n = m
        corpus_pipeline.STAGES[-1][1](spark, stage, str(tmp_path)).count()
    # The long text and one of the equal ones stay.
    kept = [(r.doc_id, len(r.text)) for r in stage.collect()]
    assert len(kept) == 2 and (3, len(long_)) in kept


def test_runs_agree(spark, tmp_path):
    rows = [(i, " ".join(f"{'pqrst'[j % 5]}{i % 40}v{j * 3 % 71}" for j in range(70 + i % 9)), f"s{i % 4}") for i in range(120)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    spark.createDataFrame([(1, "none of it")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    seen = set()
    for parts in (2, 7):
        docs.repartition(parts).write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet")
        seen.add(tuple(sorted(map(str, corpus_pipeline.run(spark, str(tmp_path)).drop("shard").collect()))))
    assert len(seen) == 1
