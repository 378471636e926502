import numpy as np
import re
import xxhash
from pyspark.sql import functions as F

from lanternlake.llm import simhash


def brute_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    k = min(3, len(words))
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + k]).encode(), 42) for i in range(len(words) - k + 1)]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(rows):
    prints = {i: brute_fingerprint(t) for i, t in rows}
    ids = list(prints)
    root = {i: i for i in ids}
    changed = True
    while changed:
        changed = False
        for a in ids:
            for b in ids:
                if bin(prints[a] ^ prints[b]).count("1") <= 2 and root[a] != root[b]:
                    root[a] = root[b] = min(root[a], root[b])
                    changed = True
    return {i: (f"{prints[i]:016x}", root[i]) for i in ids}


def test_contract_matches_brute_force(spark):
    base = "the quick brown fox jumps over the lazy dog while seven grey owls watch from a tall pine tree " * 4
    rows = [(i, base + f"ending {i}") for i in range(12)]
    rows += [(20, None), (21, ""), (22, "  \n\t"), (23, "One"), (24, "one"), (25, "two  words"), (26, "TWO words"), (50, "long text " * 20_000)]
    rows += [(30 + i, f"text number {i} is about {i * 7} other things entirely and has {i} items") for i in range(15)]
    df = spark.createDataFrame(rows, "doc_id int, text string").withColumn("fingerprint", F.lit(1))
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.op8(df).collect()}
    assert got == brute_components(rows)


def test_tiles_lose_no_link(spark):
    rng = np.random.default_rng(3)
    centre = int(rng.integers(0, 1 << 62))
    prints = {centre}
    while len(prints) < 300:
        x = int(rng.choice(list(prints)))
        prints.add(x ^ (1 << int(rng.integers(0, 12))) ^ (1 << int(rng.integers(0, 12))))
    df = spark.createDataFrame([(x,) for x in prints], "_fp long")
    from lanternlake.llm.components import connected_components

    whole = connected_components(simhash.links(df))
    tiled = connected_components(simhash.links(df, tile=16))
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, tiled.collect()))
    assert whole.select("component").distinct().count() == 1


def test_keep_one_and_empty(spark):
    rows = [(3, "a b c d"), (1, "a b c d"), (1, "a b c d"), (2, "x y z"), (None, "p q r"), (9, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("_k1", F.lit("clash"))
    kept = simhash.keep_one(df)
    assert kept.columns == df.columns
    assert sorted(map(str, (r.doc_id for r in kept.collect()))) == ["1", "2", "9", "None"]
    assert simhash.op8(df.limit(0)).count() == 0


def jaccard(a, b, width=5):
    sets = [{tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} for w in (a.lower().split(), b.lower().split())]
    return len(sets[0] & sets[1]) / len(sets[0] | sets[1])


def test_keep_one_by_true_similarity(spark):
    rng = np.random.default_rng(5)
    passage = [f"line{j}" for j in range(60)]
    rows = []
    for base in range(12):
        words = [f"w{base}x{j}" for j in range(200)] + (passage if base % 2 else [])
        for copy in range(8):
            mine = list(words)
            for at in rng.choice(200, int(rng.integers(0, 9)), replace=False):
                mine[at] = f"new{base}y{copy}z{at}"
            rows.append((len(rows), " ".join(mine)))
    root = list(range(len(rows)))
    for _ in rows:
        for i, a in rows:
            for j, b in rows[:i]:
                if i // 8 == j // 8 and root[i] != root[j] and jaccard(a, b) >= 0.8:
                    root[i] = root[j] = min(root[i], root[j])
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in simhash.similar_texts(df).collect()}
    assert got == dict(enumerate(root))
    assert 12 <= len(set(root)) < 60
    assert sorted(r.doc_id for r in simhash.keep_one(df).collect()) == sorted(set(root))
    # SimHash at two bits does not see these.
    assert simhash.near_duplicates(df).select("component_id").distinct().count() > len(set(root))


def test_parity_bits_bound_the_difference():
    rng = np.random.default_rng(7)
    for _ in range(200):
        a = rng.integers(0, 1 << 63, int(rng.integers(0, 400)), dtype=np.uint64)
        b = np.concatenate((a[: int(rng.integers(0, len(a) + 1))], rng.integers(0, 1 << 63, int(rng.integers(0, 60)), dtype=np.uint64)))
        apart = int(np.bitwise_count((simhash.parity_bits(a) ^ simhash.parity_bits(b)).view(np.uint64)).sum())
        assert apart <= len(np.setxor1d(a, b))


def test_full_comparison_loses_no_link(spark):
    """Without star rounds all pairs meet in the full comparison; sets of many sizes, shared runs, and random edits."""
    rng = np.random.default_rng(11)
    vocabulary = [f"v{i}" for i in range(40)]
    rows = []
    for base in range(10):
        words = list(rng.choice(vocabulary, int(rng.integers(6, 120))))
        for _ in range(6):
            mine = list(words)
            for _ in range(int(rng.integers(0, 4))):
                at = int(rng.integers(0, len(mine)))
                mine[at : at + int(rng.integers(0, 2))] = list(rng.choice(vocabulary, int(rng.integers(0, 3))))
            rows.append((len(rows), " ".join(mine)))
    root = list(range(len(rows)))
    for i, a in rows:
        for j, b in rows[:i]:
            if jaccard(a, b) >= 0.8:
                x, y = root[i], root[j]
                root = [min(x, y) if r in (x, y) else r for r in root]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for rounds in (0, 2):
        assert {r.doc_id: r.component_id for r in simhash.similar_texts(df, rounds=rounds).collect()} == dict(enumerate(root))
    assert 10 < len(set(root)) < 60


def test_rows_with_one_id_and_text_leave_the_same_one(spark):
    rows = [(7, "one text of five words", f"s{i}", {"k": i}) for i in range(8)]
    kept = set()
    for parts in (1, 3, 8):
        df = spark.createDataFrame(rows, "doc_id long, text string, source string, m map<string,int>").repartition(parts)
        kept.add(tuple(r.source for r in simhash.keep_one(df).collect()))
    assert len(kept) == 1 and len(kept.pop()) == 1


def test_fingerprints_link_before_shingles(spark, monkeypatch):
    """Near copies are linked by their fingerprints and checked by their sets; what fingerprints miss, shingles find."""
    plain = [f"w{j * j % 997}" for j in range(400)]
    rows = [" ".join(plain), " ".join([*plain, "end"]), " ".join([*plain[:370], *(f"n{j}" for j in range(30))])]
    rows += [f"{'lorem ipsum dolor ' * 300}{' '.join(f'{c}{j}' for j in range(25))}" for c in "xy"]
    prints = [brute_fingerprint(t) for t in rows]
    apart = lambda i, j: (prints[i] ^ prints[j]).bit_count()
    assert apart(0, 1) <= 2 < apart(0, 2) and jaccard(rows[0], rows[2]) >= 0.8
    assert apart(3, 4) <= 2 and jaccard(rows[3], rows[4]) < 0.8
    seen, verified = [], simhash._verified
    links = simhash.links
    monkeypatch.setattr(simhash, "links", lambda distinct: seen.append({r._fp % (1 << 64) for r in distinct.collect()}) or links(distinct))

    def spied(*args):
        found = verified(*args)
        seen.append((args[2].count(), found.count()))
        return found

    monkeypatch.setattr(simhash, "_verified", spied)
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in simhash.similar_texts(df).collect()} == {0: 0, 1: 0, 2: 0, 3: 3, 4: 4}
    assert seen[0] == set(prints) and seen[1] == (2, 1)
