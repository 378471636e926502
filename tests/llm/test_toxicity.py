import zlib

import numpy as np
from pyspark.sql import functions as F

from lanternlake.llm import toxicity


def corpus(n=1200):
    rng = np.random.default_rng(8)
    vocabulary = ["".join(rng.choice(list("abcdefghijklmnop"), int(rng.integers(2, 9)))) for _ in range(400)]
    bad = ["vilezork", "vilezorks", "zorkish", "mudbrain"]
    docs, labels = [], []
    for i in range(n):
        sentences = [" ".join(rng.choice(vocabulary, 8)) for _ in range(int(rng.integers(1, 9)))]
        toxic = i % 6 == 0
        if toxic:
            at = int(rng.integers(0, len(sentences)))
            sentences[at] += " é " + str(rng.choice(bad)) + " " + str(rng.choice(bad))
        docs.append((i, ". ".join(sentences) + "."))
        labels.append((i, int(toxic)))
    return docs, labels


def test_held_out_accuracy_and_sentences(spark):
    docs, labels = corpus()
    more = [(5000, None), (5001, ""), (None, "a vilezork mudbrain"), (0, docs[0][1]), (5002, "w " * 60_000), (5003, "...\n\n!!")]
    df = spark.createDataFrame(docs + more, "doc_id long, text string").withColumn("score", F.lit("clash"))
    marks = spark.createDataFrame(labels + [(None, 1), (7, None)], "doc_id long, toxic int")
    rows = toxicity.toxicity(df, marks).collect()
    assert len(rows) == len(docs) + len(more)
    truth, texts = dict(labels), dict(docs)
    for r in rows:
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
    held = [r for r in rows if r.held_out and r.doc_id in truth]
    assert np.mean([r.predicted == truth[r.doc_id] for r in held]) > 0.97
    located = [texts[r.doc_id][s.start : s.end] for r in held if r.predicted for s in r.offending]
    assert located and np.mean([any(w in s for w in ("zork", "mudbrain")) for s in located]) > 0.9
    empty = {r.score for r in rows if r.doc_id in (5000, 5001, 5003)}
    assert len(empty) == 1 and empty.pop() < 0.3


def test_held_out_labels_are_not_read(spark):
    docs, labels = corpus(300)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    flip = [(i, 1 - y if zlib.crc32(str(i).encode()) % 4 == 2 else y) for i, y in labels]
    a, b = (
        sorted(map(tuple, toxicity.op10(df, spark.createDataFrame(x, "doc_id long, toxic int")).collect()))
        for x in (labels, flip)
    )
    assert a == b


def test_empty_tables(spark):
    docs, labels = corpus(20)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    marks = spark.createDataFrame(labels, "doc_id long, toxic int")
    assert toxicity.op10(df.limit(0), marks).count() == 0
    assert {r.predicted for r in toxicity.op10(df, marks.limit(0)).collect()} == {0}
    assert {r.predicted for r in toxicity.op10(df, marks.filter("toxic = 0")).collect()} == {0}


def test_shared_texts_with_labels_that_disagree(spark):
    docs, labels = corpus(200)
    twice = [(1000 + i, t) for i, t in docs]
    marks = labels + [(1000 + i, 1 - y) for i, y in labels[:30]]
    runs = []
    for parts in (1, 5):
        df = spark.createDataFrame(docs + twice, "doc_id long, text string").repartition(parts)
        found = toxicity.fit(df, spark.createDataFrame(marks, "doc_id long, toxic int").repartition(parts))
        runs.append(found)
    assert (runs[0].weights == runs[1].weights).all() and runs[0].slope == runs[1].slope and runs[0].bias == runs[1].bias
