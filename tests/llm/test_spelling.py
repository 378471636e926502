import re
from zlib import crc32

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lanternlake.llm import spelling
from lanternlake.llm.queries import table


def brute_dictionary(rows):
    counts = {}
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            word = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = crc32(f"{'' if i is None else i}:{word}".encode())
            if h % 199 == 0:
                word = word[: h % len(word)] + word[h % len(word) + 1 :]
            counts[word] = counts.get(word, 0) + 1
    return {w: n for w, n in counts.items() if len(w) >= 6 and n >= 5}


def brute_near(words):
    """Near words through all strings with one code point left out, each with its place."""
    out = {w: set() for w in words}
    holes = {}
    for w in words:
        for i in range(len(w)):
            shorter = w[:i] + w[i + 1 :]
            holes.setdefault((shorter, i), set()).add(w)
            if shorter in out and shorter != w:
                out[w].add(shorter)
                out[shorter].add(w)
    for same in holes.values():
        for w in same:
            out[w] |= same - {w}
    return out


def brute(rows):
    words = brute_dictionary(rows)
    near = brute_near(words)
    form = {}
    for w, n in words.items():
        best = min(near[w], key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= 5 * n else None

    def root(w):
        return w if form[w] is None else root(form[w])

    return {w: (form[w], root(w), n, len(near[w]), words.get(form[w])) for w, n in words.items()}


def got(df):
    rows = df.collect()
    assert len({r.word for r in rows}) == len(rows)
    return {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in rows}


def test_contract_matches_brute_force(spark):
    base = ["banana", "bananas", "bananà", "cabana", "ananas", "Ànanas", "ànanas", "receive", "recieve", "receeve", "aaaaaa", "aaaaaaa", "aaaaaaaa"]
    rows = [(i, " ".join(base[: 1 + i % len(base)]) + " Banana-BANANA, banana×banana 中receive") for i in range(400)]
    # Chains of forms: each word is at one edit from the next and a fifth as frequent.
    rows += [(1000 + i, f"{'chainaa ' * 1000}{'chainab ' * 180}{'chainbb ' * 30}{'chaicbb ' * 5}") for i in range(3)]
    rows += [(None, "banana banana"), (5000, None), (5001, ""), (5002, "x" * 300_000 + " " + "y" * 70), (5003, "banana " * 9), (5003, "banana " * 9)]
    rows += [(6000 + i, f"{'z' * 40}a {'z' * 40}b") for i in range(6)]
    df = spark.createDataFrame([(*r, 1, "w") for r in rows], "doc_id long, text string, n int, word string").repartition(3)
    want = brute(rows)
    assert want["chaicbb"][:2] == ("chainbb", "chainaa")
    assert got(spelling.op13(df)) == want


def test_subdivided_blocks_lose_no_pair(spark):
    import itertools

    words = ["prefix" + "".join(t) for t in itertools.product("abc", repeat=5)] + ["prefix" + "".join(t) for t in itertools.product("ab", repeat=6)]
    words += [w[::-1] for w in words]
    df = spark.createDataFrame([(w, 5 + i) for i, w in enumerate(words)], "word string, n long")
    want = {(w, v) for w, near in brute_near(words).items() for v in near}
    for limit in (2, 16, 4096):
        found = [(r.word, r.near) for r in spelling.near_words(df, limit).collect()]
        assert len(found) == len(set(found)) and set(found) == want, limit


@settings(max_examples=150, deadline=None)
@given(st.sets(st.text("abé", min_size=3, max_size=7), max_size=30))
def test_blocks_hold_every_pair_once(words):
    """All blocks of a small dictionary by hand, against leaving code points out."""
    found = []
    for m in range(2, 8):
        h = m // 2
        for a, b in ((h, 0), (0, m - h)):
            held = {}
            for w in sorted(words):
                if len(w) in (m, m + 1):
                    held.setdefault(w[:a] + " " + (w[-b:] if b else ""), []).append(w)
            for block in held.values():
                short, long_ = [w for w in block if len(w) == m], [w for w in block if len(w) > m]
                if short:
                    rows = short + long_
                    found += [frozenset((rows[i], rows[j])) for i, j in spelling.near_in_block(short, long_, m, a, b)]
    assert len(found) == len(set(found))
    assert set(found) == {frozenset((w, v)) for w, near in brute_near(words).items() for v in near}


def test_empty_table(spark):
    assert spelling.op13(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    nulls = spark.createDataFrame([(None, None), (1, "   ")], "doc_id long, text string")
    assert spelling.op13(nulls).count() == 0


@pytest.mark.parametrize("folder", ["/root/testdata/sf0.001"])
def test_query_over_the_table(spark, folder):
    docs = table(spark, folder, "documents")
    assert got(spelling.op13(docs)) == brute([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])
