import hashlib
import random
import re

import numpy as np
from pyspark.sql import functions as F

from lanternlake.llm import decontaminate as D
from lanternlake.llm.fmindex import FMIndex, suffix_order

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def words_of(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items):
    out = {}
    for doc_id, text in docs:
        words, hit, found = words_of(text), set(), set()
        for item_id, body in items:
            w = words_of(body)
            size = min(13, len(w))
            windows = {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if w else set()
            for i in range(len(words) - size + 1) if w else ():
                if tuple(words[i : i + size]) in windows:
                    hit.update(range(i, i + size))
                    found.add(str(item_id))
        digest = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        out[doc_id] = (len(words), len(hit), len(found), digest, bool(hit) and 20 * len(hit) >= len(words))
    return out


def cases():
    rng = random.Random(5)
    vocabulary = ["red", "blue", "élan", "x9", "tree", "of", "the"]
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.choice([1, 2, 5, 13, 14, 30])))) for i in range(12)]
    items += [(40, None), (41, ""), (42, "!!"), (100, "The ONLY phrase, here"), (9, "dup " * 20)]
    docs = [(i, " ".join(rng.choice(vocabulary + ["other", "words"]) for _ in range(rng.randint(0, 300)))) for i in range(30)]
    docs += [(50 + i, "pad " * (7 * i) + items[i % 12][1].upper() + ". end " * 9) for i in range(12)]
    docs += [(90, None), (91, ""), (92, "the-only\tphrase\nHERE"), (93, "dup " * 50), (94, "the only"), (95, "phrase here")]
    return docs, items


def test_contract_matches_brute_force(spark):
    docs, items = cases()
    df = spark.createDataFrame(docs, "doc_id int, text string").withColumn("spans", F.lit(1))
    bench = spark.createDataFrame(items, "item_id int, text string")
    expected = brute(docs, items)
    got = {r.doc_id: tuple(r)[1:] for r in D.op5(df, bench).collect()}
    assert got == expected
    blocks = D.contamination(df, bench, benchmark_bytes=150, shard_bytes=300)
    assert {r.doc_id: tuple(r)[1:6] for r in blocks.collect()} == expected
    # Repeated rows, and texts longer than a shard.
    again = [(i, t) for i, t in docs[:5]] * 3 + [(300, "pad words " * 90_000 + items[0][1]), (301, None), (None, items[1][1])]
    more = D.op5(spark.createDataFrame(again, "doc_id int, text string").withColumn("_items", F.lit("clash")), bench).collect()
    want = brute([(i if i is not None else -1, t) for i, t in again], items)
    assert len(more) == len(again) and all(tuple(r)[1:] == want[r.doc_id if r.doc_id is not None else -1] for r in more)
    kept = D.drop_contaminated(df, bench)
    assert kept.columns == df.columns
    assert {r.doc_id for r in kept.collect()} == {k for k, v in expected.items() if not v[4]}
    assert D.op5(df.limit(0), bench).count() == 0
    assert D.op5(df, bench.limit(0)).filter("n_hit > 0 or contaminated").count() == 0


def test_index_against_plain_search():
    rng = np.random.default_rng(1)
    for alphabet, n in ((2, 50), (3, 700), (40, 3000)):
        text = np.append(rng.integers(0, alphabet + 1, n), 0)
        index = FMIndex(text)
        assert sorted(suffix_order(text)) == list(range(len(text)))
        patterns = rng.integers(1, alphabet + 1, (200, 4))
        patterns[::9, 0] += 64  # symbols that the text lacks
        lengths = rng.integers(1, 5, 200)
        low, high = index.search(patterns.ravel(), np.arange(200) * 4, lengths)
        for p, m, a, b in zip(patterns, lengths, low, high):
            want = [i for i in range(len(text) - m + 1) if (text[i : i + m] == p[:m]).all()]
            assert sorted(index.locate(np.arange(a, max(a, b))).tolist()) == want
