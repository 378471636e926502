import os
import random
import subprocess
import sys

import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F

from lanternlake.llm import tokens


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(tokens.MODEL))


def texts():
    rng = random.Random(2)
    out = ["", " ", "  a", "a▁ b ▁▁ c", "日本語𝄞 x", "\n\n a", "<s> </s><unk><0x0A>", "ab" * 700, " " * 999, "the" * 400]
    out += ["".join(rng.choice("abcdeth noi.,\n -éß0123") for _ in range(rng.randint(1, 600))) for _ in range(80)]
    ranges = [(32, 126), (160, 700), (0x3040, 0x30FF), (0x20, 0x20), (0x2581, 0x2581), (0x1F300, 0x1F600)]
    out += ["".join(chr(rng.randint(*rng.choice(ranges))) for _ in range(rng.randint(1, 400))) for _ in range(40)]
    return out


def test_counts_equal_the_library(library):
    machine = tokens.Transducer(tokens.Vocabulary(public_tokenizers.path(tokens.MODEL)))
    want = [len(x) for x in library.encode(texts())]
    assert machine.counts(texts()).tolist() == want
    assert machine.counts(texts()[::-1]).tolist() == want[::-1]


def test_chunks_do_not_matter(library, monkeypatch):
    monkeypatch.setattr(tokens, "CHUNK", 7)
    machine = tokens.Transducer(tokens.Vocabulary(public_tokenizers.path(tokens.MODEL)))
    assert machine.counts(texts()).tolist() == [len(x) for x in library.encode(texts())]


def test_a_million_characters_without_spaces(library):
    rng = random.Random(4)
    words = "the of tion ment heit und que les información straße".split()
    mixed = "".join(rng.choice(words) for _ in range(250_000))[:1_000_000]
    odd = "".join(rng.choice("abcdefgh中文字漢é😀") for _ in range(300_000))
    machine = tokens.Counter(tokens.Vocabulary(public_tokenizers.path(tokens.MODEL)))
    assert len(mixed) == 1_000_000
    for text in (mixed, "a" * 1_000_000, "ab" * 250_000, "abc" * 100_001, odd, "x " + mixed[:5000] + " y" + "-" * 40_000):
        assert machine.counts([text]).tolist() == [len(library.encode(text))]


def test_state_maps_compose(library, monkeypatch):
    # Tables for the states of a whole stretch, or for none: the same counts.
    text = ["ab" * 900 + "c" * 700, "the" * 999, "中" * 500 + "aaaa" * 321]
    want = [len(x) for x in library.encode(text)]
    monkeypatch.setattr(tokens, "CHUNK", 5)
    for common in (0, 3, 1000):
        monkeypatch.setattr(tokens, "COMMON_STATES", common)
        machine = tokens.Transducer(tokens.Vocabulary(public_tokenizers.path(tokens.MODEL)))
        assert machine.counts(text).tolist() == want


def test_full_tables_begin_anew_within_a_text(library, monkeypatch):
    monkeypatch.setattr(tokens, "MAX_STATES", 400)
    monkeypatch.setattr(tokens, "MAX_TRANSITIONS", 900)
    monkeypatch.setattr(tokens, "STRETCH", 5000)
    monkeypatch.setattr(tokens, "LEAST_STRETCH", 20)
    monkeypatch.setattr(tokens, "MAX_PAIRS", 50)
    long_ = "".join(texts()) * 2 + "the quick ment" * 300 + "ab" * 3000
    counter = tokens.Counter(tokens.Vocabulary(public_tokenizers.path(tokens.MODEL)))
    assert counter.counts([long_]).tolist() == [len(library.encode(long_))]
    assert counter.counts(texts()).tolist() == [len(x) for x in library.encode(texts())]


MEMORY = """
import random, resource, sentencepiece, public_tokenizers, sys
from lanternlake.llm import tokens
path = public_tokenizers.path(tokens.MODEL)
library = sentencepiece.SentencePieceProcessor(model_file=path)
rng = random.Random(8)
counter = tokens.Counter(tokens.Vocabulary(path))
symbols = sorted(p for p in counter.vocabulary.score if len(p) == 1)
counter.counts(["warm up"])
texts = ["".join(rng.choice("etaoinshrdlu") for _ in range(400_000)), "".join(rng.choice(symbols) for _ in range(400_000))]
want = [len(library.encode(t)) for t in texts]
before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
assert counter.counts(texts).tolist() == want
print(resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before)
"""


def test_memory_is_bounded():
    env = dict(os.environ, PYTHONPATH=os.pathsep.join(sys.path))
    out = subprocess.run([sys.executable, "-c", MEMORY], env=env, capture_output=True, text=True, timeout=600)
    assert out.returncode == 0, out.stderr
    assert int(out.stdout) < 500_000  # KB


def test_a_change_that_does_not_fit_is_an_error():
    machine = tokens.Transducer(tokens.Vocabulary(public_tokenizers.path(tokens.MODEL)))
    with pytest.raises(ValueError):
        machine.pack((("", None, 0),), 32)
    with pytest.raises(ValueError):
        machine.pack((("", None, 0),), -33)


def test_contract(spark, library):
    rows = list(enumerate(texts())) + [(900, None), (901, "word " * 5000), (None, "x"), (0, "")]
    df = spark.createDataFrame(rows, "doc_id int, text string").withColumn("n_bytes", F.lit("clash"))
    want = sorted(
        (str(i), len((t or "").encode()), n, n > 4096)
        for (i, t), n in zip(rows, (len(x) for x in library.encode([t or "" for _, t in rows])))
    )
    assert sorted((str(r.doc_id), *tuple(r)[1:]) for r in tokens.op4(df).collect()) == want
    assert tokens.op4(df.limit(0)).count() == 0
