import re
from collections import Counter
from difflib import SequenceMatcher

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import functions as F

from lanternlake.functions import curation, text
from lanternlake.operators import chunks, evidence, lexical, retrieval
from lanternlake.plans import retrieval_queries
from lanternlake.sources import store


def test_chunks_keep_pages_and_sizes(spark):
    body = "HƯỚNG DẪN CÀI ĐẶT\n" + "Mở phần mềm và đăng nhập bằng tài khoản được cấp. " * 40
    df = spark.createDataFrame([("Hướng dẫn EOS.pdf", 7, body), ("x.pdf", 1, None), ("y.pdf", 1, "short")], "source string, page int, content string")
    rows = chunks.chunk_pages(df).collect()
    assert len(rows) > 1 and {r.page for r in rows} == {7}
    for r in rows:
        assert len(r.text) <= 380 and len(r.parent_text) <= 1200 and r.parent_id
        assert r.retrieval_text.startswith("Hướng dẫn EOS > HƯỚNG DẪN CÀI ĐẶT\n")
    assert len({r.child_id for r in rows}) == len(rows)


def test_split_covers_the_text():
    words = [f"w{i}" for i in range(900)]
    for size, overlap in ((100, 0), (50, 20)):
        pieces = chunks.split_text(" ".join(words), size, overlap)
        assert all(len(p) <= size for p in pieces)
        seen = [w for p in pieces for w in p.split()]
        assert set(seen) == set(words) and (overlap or seen == words)
    assert chunks.split_text("", 10) == [] and chunks.split_text("x" * 25, 10) == ["x" * 10, "x" * 10, "x" * 5]


def test_headings(spark):
    rows = ["- small line\nBước 2: mở máy\nmore", "plain first\nsecond", "", None, "\n\nHEADING  here -\nx", "a\nb\nc\nd\ne\nf\nTOO LATE", "x" * 300]
    got = spark.createDataFrame(list(enumerate(rows)), "i int, t string").select(chunks.page_heading(F.col("t")).alias("h")).collect()
    assert [r.h for r in got] == ["Bước 2: mở máy", "plain first", "", "", "HEADING here", "a", "x" * 180]


def test_bm25_finds_codes_without_accents(spark):
    corpus = spark.createDataFrame([(0, "Mã lỗi SEB-101 khi đăng nhập"), (1, "Quy chế thi"), (2, "Phòng máy và thiết bị")], "idx long, text string")
    hits = retrieval.bm25_top(spark.createDataFrame([(1, "ma loi seb-101")], "query_id long, text string"), corpus, 2).collect()
    assert min(hits, key=lambda r: r.bm25_rank).idx == 0


def test_bm25_by_hand(spark):
    docs = ["a1 b1 b1", "a1 c1", "d1 e1 f1 a1"]
    corpus = spark.createDataFrame(list(enumerate(docs)), "idx long, text string")
    got = {r.idx: r.bm25_score for r in retrieval.bm25_top(spark.createDataFrame([(1, "b1 b1 d1")], "query_id long, text string"), corpus).collect()}
    tokens = [[c + w for c in ("raw:", "fold:") for w in d.split()] for d in docs]
    n, avg = 3, np.mean([len(t) for t in tokens])
    df = {}
    for t in tokens:
        for w in set(t):
            df[w] = df.get(w, 0) + 1
    idf = {w: np.log(n - c + 0.5) - np.log(c + 0.5) for w, c in df.items()}
    mean = np.mean(list(idf.values()))
    idf = {w: 0.25 * mean if v < 0 else v for w, v in idf.items()}
    for i, t in enumerate(tokens):
        score = 0
        for w in ["raw:b1", "raw:b1", "raw:d1", "fold:b1", "fold:b1", "fold:d1"]:
            f = t.count(w)
            score += idf.get(w, 0) * f * 2.5 / (f + 1.5 * (0.25 + 0.75 * len(t) / avg))
        assert abs(got.get(i, 0) - score) < 1e-5


def test_dense_blocks_agree(spark):
    rng = np.random.default_rng(0)
    v = rng.normal(size=(60, 8)).astype(np.float32)
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "idx long, vector array<float>").repartition(3)
    q = df.filter("idx < 7").select(F.col("idx").alias("query_id"), "vector")
    one = sorted(map(tuple, retrieval.dense_top(q, df, 5).collect()))
    assert one == sorted(map(tuple, retrieval.dense_top(q, df, 5, block=2).collect()))
    for i in range(7):
        want = np.argsort(-(v.astype(float) @ v[i].astype(float)), kind="stable")[:5].tolist()
        assert [r[1] for r in sorted(one, key=lambda r: r[3]) if r[0] == i] == want
    assert retrieval.dense_top(q.limit(0), df, 5).count() == 0


def test_fusion_and_gate(spark):
    dense = spark.createDataFrame([(1, 0, 0.9, 1), (1, 1, 0.89, 2)], "query_id long, idx long, dense_score double, dense_rank int")
    sparse = spark.createDataFrame([(1, 2, 10.0, 1), (1, 0, 9.0, 2)], "query_id long, idx long, bm25_score double, bm25_rank int")
    rows = sorted(retrieval.fuse(dense, sparse).collect(), key=lambda r: r.fused_rank)
    assert rows[0].idx == 0 and rows[0].matched_both and [r.idx for r in rows] == [0, 2, 1]
    for d, b, want in ((0.81, 19.0, False), (0.85, None, True), (0.81, 21.0, True)):
        x = spark.createDataFrame([(1, 0, d, 1)], dense.schema)
        y = spark.createDataFrame([(1, 0, b, 1)] if b else [], sparse.schema)
        assert retrieval.confident(x, y, 0.84, 20.0).first().passed is want


def test_parents_and_selection(spark):
    same = "Một nội dung trùng nhau " * 5
    kids = [(1, "p1", "a", 1, 0.02, same), (1, "p1", "a", 2, 0.019, same), (1, "p2", "b", 3, 0.018, same)]
    parents = retrieval.roll_up(spark.createDataFrame(kids, "query_id long, parent_id string, source string, rank int, combined_score double, content string"))
    rows = sorted(parents.collect(), key=lambda r: r.parent_rank)
    assert [r.parent_id for r in rows] == ["p1", "p2"]
    assert [r.parent_id for r in evidence.select_evidence(parents).collect()] == ["p1"]


def test_budget_skips_and_goes_on(spark):
    long = [" ".join(f"{c}{i}" for i in range(n)) for c, n in (("a", 2000), ("b", 900), ("c", 40))]
    rows = [(1, f"p{i}", i + 1, "s", t, 1.0) for i, t in enumerate(long)] + [(1, "p9", 9, "s", "", 0.1)]
    df = spark.createDataFrame(rows, "query_id long, parent_id string, parent_rank int, source string, content string, combined_score double")
    got = [(r.evidence_id, r.parent_id) for r in evidence.select_evidence(df, budget=len(long[0]) + 500).collect()]
    assert got == [("E1", "p0"), ("E2", "p2")]
    assert evidence.context(evidence.select_evidence(df)).first().context.startswith("[E1]\nSource: s\nPage: \nSection: Không có\nContent:\na0 a1")


def test_context_of_versions(spark):
    rows = [
        (1, "E1", "a.pdf", 3, "Tải", "Mục > Tải", "nội dung", "release_notice", "2024-02-01", None),
        (1, "E2", "b.pdf", 4, "", "Mục", "khác", "general", "2024-02-01", "controlled_differential_fallback"),
        (2, "E1", "a.pdf", 3, "Tải", "Mục > Tải", "nội dung", "release_notice", None, "current_explicit_latest_query"),
        (2, "E2", "b.pdf", 4, "", "Mục", "khác", None, None, None),
    ]
    columns = "query_id int, evidence_id string, source string, page int, heading string, section_path string, content string, subtype string, day string, action string"
    got = {r.query_id: r.context for r in evidence.context(spark.createDataFrame(rows, columns)).collect()}
    released = evidence.RELEASED % "2024-02-01"
    assert got[1] == (
        f"[E1]\nSource: a.pdf\nPage: 3\nSection: Mục > Tải\n{released}Content:\nnội dung\n\n[E2]\nSource: b.pdf\nPage: 4\nSection: Mục\nContent:\nkhác"
    )
    assert got[2] == (
        f"[E1]\nSource: {evidence.SUPPORTING}\nPage: 3\nSection: Tải\nContent:\nnội dung\n\n[E2]\nSource: {evidence.SUPPORTING}\nPage: 4\nSection: Không có\nContent:\nkhác"
    )


def test_near_duplicates(spark):
    a, b = "one two three four five six seven", "one two three four five six eight"
    assert SequenceMatcher(None, a, b).ratio() < 0.88
    rng = np.random.default_rng(4)
    texts = ["a b", "a b", a, b, a + " " + b, b + " " + a, "abcdefghij" * 30, "abcdefghij" * 29 + "abcdefghix"]
    texts += [" ".join(rng.choice(["xa", "xb", "xc", "xd", "xe"], 9)) for _ in range(12)]
    got = {(r.place, o) for r in evidence.near_duplicates(spark.createDataFrame([(1, i, t) for i, t in enumerate(texts)], "query_id long, place int, key string")).collect() for o in r.like}
    want = set()
    for j, x in enumerate(texts):
        for i, y in enumerate(texts[:j]):
            m, n = set(x.split()), set(y.split())
            if x == y or len(m & n) / len(m | n) >= 0.78 or SequenceMatcher(None, x, y).ratio() >= 0.88:
                want.add((j, i))
    assert got == want and (1, 0) in got and (3, 2) not in got and (5, 4) in got and (7, 6) in got


def test_repeated_sequences_match_brute_force(spark):
    rng = np.random.default_rng(6)
    texts = [" ".join(rng.choice(["a", "b", "c", "d"], int(rng.integers(20, 90)))) for _ in range(40)] + ["go on now " * 30, None, "", "short text"]
    got = sorted(map(tuple, evidence.repeated_sequences(spark.createDataFrame([(i % 41, t) for i, t in enumerate(texts)], "id int, text string")).collect()))
    want = []
    for i, t in enumerate(texts):
        w = (t or "").split()
        for n in range(3, 9) if len(w) >= 24 else ():
            runs = [tuple(w[k : k + n]) for k in range(len(w) - n + 1)]
            most = max(runs.count(r) for r in runs)
            want.append((i % 41, n, most, most >= 4 and most * n >= max(18, len(w) // 4)))
    assert got == sorted(want)


def test_similar_sets_match_brute_force(spark):
    rng = np.random.default_rng(2)
    sets = [sorted({f"t{x}" for x in rng.zipf(1.5, int(rng.integers(1, 25))) % 40}) for _ in range(150)]
    sets += [s[1:] if len(s) > 5 else s for s in sets[:60]] + [[], []]
    df = spark.createDataFrame(list(enumerate(sets)), "id long, tokens array<string>")
    got = {(r.left, r.right): r.jaccard for r in retrieval.similar_sets(df).collect()}
    first = {}
    for i, s in enumerate(sets):
        if s:
            first.setdefault(tuple(s), i)
    want = {}
    for x, i in first.items():
        for y, j in first.items():
            if i < j and len(set(x) & set(y)) / len(set(x) | set(y)) >= 0.78:
                want[i, j] = len(set(x) & set(y)) / len(set(x) | set(y))
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_primary_source(spark):
    cited = spark.createDataFrame([(1, 0, "e1"), (1, 1, "E2"), (1, 2, "E3"), (2, 0, "E1"), (2, 1, "E2"), (2, 2, "E3"), (2, 3, "E2"), (3, 0, "E9")], "answer_id int, position int, evidence_id string")
    ev = [(1, "E1", "secondary.pdf", 0.01), (1, "E2", "primary.pdf", 0.03), (1, "E3", "primary.pdf", 0.02), (2, "E1", "first.pdf", None), (2, "E2", "second.pdf", None), (2, "E3", "second.pdf", None)]
    got = evidence.primary_source(cited, spark.createDataFrame(ev, "answer_id int, evidence_id string, file_name string, score double")).collect()
    assert {r.answer_id: r.file_name for r in got} == {1: "primary.pdf", 2: "second.pdf"}


def test_rules(spark):
    df = spark.createDataFrame([("Lỗi MẬT KHẨU",), ("camera hỏng",), ("",), ("thoi gian",)], "q string")
    assert [r[0] for r in df.select(curation.topic(F.col("q"))).collect()] == ["Login & Account Issues", "Device & Hardware Issues", "General Guidance", "General Guidance"]
    v = spark.createDataFrame([("vào phòng  thu mở WIFI wifi6",)], "t string").select(curation.voice_fixes(F.col("t"))).first()[0]
    assert v == "vào phòng thi mở Wi-Fi wifi6"
    c = spark.createDataFrame([("a [Sử dụng E1] , b [Nguồn: E2]\n\n\n\nc [E 3]  ",)], "a string")
    r = c.select(curation.normalise_citations(F.col("a")), curation.cited(F.col("a")), curation.strip_citations(F.col("a"))).first()
    assert r[0] == "a [E1] , b [E2]\n\n\n\nc [E3]  " and r[1] == ["E1", "E2", "E3"] and r[2] == "a, b\n\nc"
    d = spark.createDataFrame([("ngày 01.02.20.24 và 3-4-20_19",)], "t string").select(curation.repair_dates(F.col("t"))).first()[0]
    assert d == "ngày 01.02.2024 và 3-4-2019"
    i = spark.createDataFrame([("Mã SEB-101 của FU-Exam 2024 x1",)], "t string").select(text.identifiers(F.col("t"), F.lower("t"))).first()[0]
    assert i == ["2024", "fu-exam", "seb-101", "x1"]
    f = spark.createDataFrame([("Đăng  NHẬP\nß",)], "t string").select(text.fold_ws("t"), text.fold_raw("t")).first()
    assert tuple(f) == ("dang nhap ss", "dang  nhap\nss")


def test_verdicts_fail_closed(spark):
    replies = [
        ('x {"relevant": false, "error_text": " E1 "} y', (False, "")),
        ('{"relevant": true, "error_text": "a{b}"}', (True, "a{b}")),
        ('so {"relevant": true, "error_text": " E1  \\n code "} there', (True, "E1 code")),
        ('{"relevant": "true", "error_text": "a"}', (False, "")), ('{"relevant": true, "error_text": 5}', (False, "")),
        ('{"relevant": true, "error_text": "  "}', (False, "")), ('{"relevant": true, "error_text": "a"', (False, "")),
        ('{"relevant": true, "error_text": "' + "z" * 501 + '"}', (False, "")),
        ('{"relevant": true, "error_text": "' + "z" + " " * 600 + 'y"}', (True, "z y")),
        ("free text", (False, "")),
        (None, (False, "")),
    ]
    df = spark.createDataFrame([(i, r) for i, (r, _) in enumerate(replies)], "i int, r string")
    got = {x.i: tuple(x.v) for x in df.select("i", curation.parse_verdict(F.col("r")).alias("v")).collect()}
    assert got == {i: w for i, (_, w) in enumerate(replies)}


def test_bm25_blocks_and_a_stored_index_agree(spark, tmp_path):
    rng = np.random.default_rng(3)
    docs = [" ".join(f"w{x}" for x in rng.zipf(1.5, rng.integers(0, 40)) % 50) for _ in range(80)] + [None, ""]
    corpus = spark.createDataFrame(list(enumerate(docs)), "idx long, text string").repartition(4)
    asked = spark.createDataFrame([(i, docs[i * 7]) for i in range(10)] + [(99, None), (98, "unknown")], "query_id long, text string")
    once = sorted(map(tuple, retrieval.bm25_top(asked, corpus, 4).collect()))
    assert once == sorted(map(tuple, retrieval.bm25_top(asked, corpus, 4, block=3).collect()))
    root = str(tmp_path)
    store.install(root, retrieval.bm25_index(corpus))
    kept = {name: store.load(spark, root, name) for name in ("blocks", "words", "totals")}
    assert once == sorted(map(tuple, retrieval.bm25_top(asked, None, 4, index=kept).collect()))
    every = retrieval.bm25_top(asked, corpus, 1000).collect()
    for q in {r.query_id for r in every}:
        best = sorted((r for r in every if r.query_id == q), key=lambda r: (-r.bm25_score, r.idx))[:4]
        assert sorted((q, r.idx, r.bm25_score, i + 1) for i, r in enumerate(best)) == [r for r in once if r[0] == q]
    assert retrieval.bm25_top(asked, corpus.limit(0), 4).count() == 0


def test_page_numbers_of_a_large_source(spark):
    rng = np.random.default_rng(7)
    rows = [(["hot", "a", None][min(int(x), 2)], int(i)) for i, x in zip(rng.permutation(3000), rng.exponential(0.7, 3000))]
    got = {(r.source, r.doc_id): r.page for r in chunks.page_numbers(spark.createDataFrame(rows, "source string, doc_id long")).collect()}
    assert len(got) == len(rows)
    for source in ("hot", "a", None):
        mine = sorted(i for s, i in rows if s == source)
        assert [got[source, i] for i in mine] == list(range(1, len(mine) + 1))
    assert chunks.page_numbers(spark.createDataFrame([], "source string, doc_id long")).count() == 0


def test_children_without_parents_stay_apart(spark):
    rows = [(1, None, 1, 0.5, "a", "x"), (1, None, 2, 0.4, "b", "x"), (1, "", 3, 0.3, "c", "y"), (1, "p", 4, 0.2, "d", "y")]
    got = retrieval.roll_up(spark.createDataFrame(rows, "query_id int, parent_id string, rank int, combined_score double, content string, source string"))
    assert sorted((r.parent_id, r.content) for r in got.collect()) == [("p", "d"), ("x::rank-1", "a"), ("x::rank-2", "b"), ("y::rank-3", "c")]


def test_procedures_from_chunks(spark):
    rows = [
        ("A.pdf", "Cài đặt > Cài  đặt: > Bước 1: mở > x", None, "3", "BƯỚC 1 mở; step 2", ""),
        ("A.pdf", "Cài đặt", "no", "5", None, "bước 4"),
        ("A.pdf", "", "Cài đặt", "6", "", "Bước 4 lại"),
        ("A.pdf", "Cài đặt > Gỡ bỏ", None, "6", "step 1", ""),
        ("A.pdf", "Step 1 > x", None, "7", "step 1", ""),
        ("A.pdf", "Cài đặt", None, "?", "step 9", ""),
        (None, "Cài đặt", None, "8", "step 9", ""),
        ("B.pdf", "Cài đặt", None, "1", "buoc12a misstep 3", None),
    ]
    got = evidence.procedure_catalogue(spark.createDataFrame(rows, "source string, section_path string, heading string, page string, parent_text string, text string"))
    assert sorted((r.source, r.section, r.page, r.group_pages) for r in got.collect()) == [
        ("A.pdf", "cai dat", 3, [3, 5]), ("A.pdf", "cai dat", 5, [3, 5]), ("A.pdf", "cai dat", 6, [6]), ("A.pdf", "cai dat > go bo", 6, [6]),
    ]


def test_list_of_evidence(spark):
    rows = [
        (1, "E1", "A.pdf", 3, "p1", "Cài đặt > Bước 1: mở", None, 0.5, 2, "f", "2024-01-01", 2, None, "only_or_current_version_v3", False),
        (1, "E2", "A.pdf", 9, "p2", "", "Cài đặt", None, None, None, None, None, "release_notice", None, None),
        (2, "E1", "B.pdf", 1, "p3", None, None, 0.1, 1, None, None, None, None, "x", True),
    ]
    schema = (
        "query_id int, evidence_id string, source string, page int, parent_id string, section_path string, heading string, combined_score double, matched int, family_id string,"
        " day string, version_rank int, subtype string, action string, historical boolean"
    )
    procedures = spark.createDataFrame([("A.pdf", "cai dat", 3, [3, 5]), ("A.pdf", "khac", 9, [9])], "source string, section string, page int, group_pages array<int>")
    found = evidence.source_documents(spark.createDataFrame(rows, schema), procedures)
    got = {(r.query_id, r.evidence_id): r for r in found.collect()}
    assert got[1, "E1"].procedural_pages == [3, 5] and got[1, "E1"].matched_child_count == 2 and got[1, "E1"].document_date == "2024-01-01"
    assert got[1, "E2"].procedural_pages == [] and got[1, "E2"].score == 0.0 and got[1, "E2"].matched_child_count == 0 and got[1, "E2"].historical is False
    assert got[2, "E1"].historical and got[2, "E1"].temporal_action == "x" and got[2, "E1"].file_name == "B.pdf"
    few = spark.createDataFrame([r[:8] for r in rows], ", ".join(schema.split(", ")[:8]))
    assert evidence.source_documents(few, procedures.limit(0)).filter("size(procedural_pages) = 0 and not historical").count() == 3


def test_pages_that_look_alike(spark):
    rng = np.random.default_rng(2)
    rows = []
    for answer in range(12):
        base = int(rng.integers(-(1 << 62), 1 << 62))
        for position in range(9):
            flips = rng.choice(64, int(rng.integers(0, 30)), replace=False)
            value = base
            for f in flips:
                value ^= 1 << int(f)
            rows.append((answer, position, (value + (1 << 63)) % (1 << 64) - (1 << 63)))
    want = set()
    for answer in range(12):
        kept = []
        for a, position, h in rows:
            if a == answer and all(bin((h ^ k) & (1 << 64) - 1).count("1") > 15 for k in kept):
                kept.append(h)
                want.add((a, position, h))
    got = {tuple(r) for r in evidence.unique_pages(spark.createDataFrame(rows, "answer_id long, position int, phash long")).collect()}
    assert got == want and len(want) < len(rows)


def test_chunks_over_the_table(spark):
    """Every page of the smallest table: children lie in their parents, parents cover the cleaned page in order, and nothing short is kept."""
    from lanternlake.functions.text import clean_page
    from lanternlake.sources.tables import read

    docs = read(spark, "/root/testdata/sf0.001", "documents").select("source", F.col("doc_id").cast("int").alias("page"), F.col("text").alias("content"))
    clean = {r.page: r.c for r in docs.select("page", clean_page(F.col("content")).alias("c")).collect()}
    pages = {}
    for r in chunks.chunk_pages(docs, 0).collect():
        pages.setdefault(r.page, {}).setdefault(int(r.parent_id.rsplit("-", 1)[1]), []).append(r)
    assert set(pages) == {p for p, c in clean.items() if c}
    for page, parents in pages.items():
        assert sorted(parents) == list(range(len(parents)))
        words = []
        for number in sorted(parents):
            rows = sorted(parents[number], key=lambda r: r.position)
            parent = rows[0].parent_text
            words += parent.split()
            assert len(parent) <= chunks.PARENT and all(r.text in parent and len(r.text) <= chunks.CHILD for r in rows)
            at = [parent.find(r.text) for r in rows]
            assert at[0] == 0 and at == sorted(at) and rows[-1].text == parent[-len(rows[-1].text) :]
        assert words == clean[page].split()


def test_tasks_hold_small_batches(spark, tmp_path):
    from pyarrow import dataset

    from lanternlake.sources import tables, work

    names = ("spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch")
    before = [spark.conf.get(n) for n in names]
    spark.conf.set(names[0], "10000")
    spark.conf.set(names[1], "64m")
    try:
        wide = spark.range(600).repartition(1).select("id", F.expr("transform(sequence(1, 12000), x -> xxhash64(id, x))").alias("a"))
        work.write_table(wide, f"{tmp_path}/documents.parquet")
        groups = [g.num_rows for f in dataset.dataset(f"{tmp_path}/documents.parquet", format="parquet").get_fragments() for g in f.row_groups]
        assert sum(groups) == 600 and max(groups) < 300
        spark.conf.set(names[0], "10000")
        assert tables.read(spark, str(tmp_path), "documents").count() == 600
        assert int(spark.conf.get(names[0])) <= work.BATCH_ROWS and int(spark.conf.get(names[1])) <= work.BATCH_BYTES
    finally:
        for n, value in zip(names, before):
            spark.conf.set(n, value)


def test_chunks_leave_a_task_in_small_batches():
    """A batch of long pages is no single frame of all its chunks, and pieces are those of a search through all boundaries."""
    rng = np.random.default_rng(3)
    text = "".join(rng.choice(["word", " ", ". ", "; ", ": ", "\n", "\u2003", "xxxxxxxxxxxxxxxxxxxxxxxx"], 400_000, p=[0.5, 0.35, 0.03, 0.02, 0.02, 0.02, 0.02, 0.04]))
    pages = pa.table({"source": ["a.txt", None], "page": pa.array([1, 2], pa.int32()), "content": [text, "short text of one chunk"], "heading": ["Head", None]})
    found = list(chunks._chunks(pages.to_batches()))
    assert len(found) > 1 and max(b.nbytes for b in found) < 4 * chunks.BATCH_BYTES
    assert found[-1].column(found[-1].schema.get_field_index("text"))[-1].as_py() == "short text of one chunk"
    piece, size, overlap = text[:20_000], 380, 70
    ends = [(mark, [m.end() for m in re.finditer(re.escape(mark), piece)]) for mark in chunks.BOUNDARIES]
    words = [m.end() for m in re.finditer(r"\s", piece)]
    start, end, want = 0, 0, []
    while end < len(piece):
        end = limit = min(start + size, len(piece))
        if limit < len(piece):
            least = start + int(size * chunks.MIN_SHARE)
            end = next((max(good) for mark, e in ends if (good := [x for x in e if x <= limit and x - len(mark) >= least])), limit)
        want.append((start, end))
        at = max(end - overlap, start + 1)
        start = min(next((w for w in words if w >= at), end), end)
    assert list(chunks.spans(piece, size, overlap)) == want


def test_texts_are_cut_into_sets_once(spark):
    """A filter on the sets and a second use of the classes each cut all texts again."""
    seen = spark.sparkContext.accumulator(0)

    @F.pandas_udf("string")
    def counted(t: pd.Series) -> pd.Series:
        seen.add(len(t))
        return t

    rows = spark.createDataFrame([(1, "a b c d e"), (2, "a b c d e"), (3, "a b c d e f"), (4, ""), (5, "x y")], "id long, text string")
    sets = rows.select("id", F.filter(F.array_distinct(F.split(counted("text"), " ")), lambda x: x != "").alias("tokens"))
    assert [tuple(r)[:2] for r in retrieval.similar_sets(sets).collect()] == [(1, 3)]
    assert seen.value == 5


def test_word_counts_leave_a_task_added_up(spark):
    """Terms of several blocks are one row of a task, and the counts are those of the documents."""
    rows = [(i, f"w{i % 3} w{i % 5} É É-1 a") for i in range(90)] + [(90, None), (91, "plain a plain")]
    blocks = lexical.block_table(spark.createDataFrame(rows, "idx long, text string"), 4)
    held = blocks.select("terms", "held").toArrow()
    (batch,) = lexical._words(held.combine_chunks().to_batches())
    want = Counter()
    for _, t in rows:
        want.update({f"{name}{w}" for name, form in (("raw:", str.lower), ("fold:", text.fold)) for w in form(t or "").split() if len(w) > 1})
    found = dict(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()))
    assert len(found) == batch.num_rows and found == dict(want)
    assert {r["token"]: r["df"] for r in lexical.word_table(blocks).collect()} == found


def test_paths_and_texts_of_chunks_are_folded_once(spark):
    """The plan over the chunks has no Python; it folded every row again, and twice where a filter moved down."""
    rows = [("A.pdf", f"Cài đặt > Bước {i % 7}: mở", None, str(i % 40), f"Bước {i % 9}", "") for i in range(400)]
    rows += [("A.pdf", None, None, "1", "bước 3", ""), ("A.pdf", "Khác", None, "1", None, None), ("A.pdf", "Khác", None, "2", "không", "bước 8")]
    got = evidence.procedure_catalogue(spark.createDataFrame(rows, "source string, section_path string, heading string, page string, parent_text string, text string").localCheckpoint())
    assert "Python" not in got._jdf.queryExecution().toString()
    assert {(r.section, r.page) for r in got.collect()} == {("cai dat", i) for i in range(40)}


def test_ratios_are_dealt_to_all_cores(spark):
    rows = [(1, i, "loi dang nhap he thong " * 6 + "abcdefgh"[i]) for i in range(8)] + [(2, 1, "x"), (2, 2, "y")]
    found = evidence.near_duplicates(spark.createDataFrame(rows, "query_id int, place int, key string"))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    # The filter stays above the exchange that deals out the pairs.
    assert -1 < plan.find("_near_sequences(") < plan.find("RepartitionByExpression")
    assert {(r.query_id, r.place): sorted(r.like) for r in found.collect()} == {(1, i): list(range(i)) for i in range(1, 8)}


def test_terms_come_back_from_joined_texts():
    got = lexical._listed(pa.array(["", "a\nbb", "", "c", ""]))
    assert got.to_pylist() == [[], ["a", "bb"], [], ["c"], []]
    assert lexical._listed(pa.array([], pa.string())).to_pylist() == []


def test_only_hits_go_on_with_their_texts(spark, monkeypatch):
    held, write = {}, retrieval_queries.work_table

    def kept(df, name):
        held[name] = write(df, name)
        return held[name]

    monkeypatch.setattr(retrieval_queries, "work_table", kept)
    retrieval_queries.QUERIES["greedy_select"](spark, "/root/testdata/sf0.001")
    assert "retrieval_text" not in held["children"].columns
    assert 0 < held["hit-children"].count() == held["fused"].select("idx").distinct().count() < held["children"].count()
    assert all(".zstd." in f for f in held["children"].inputFiles())


def test_sets_move_as_numbers(spark, monkeypatch):
    held, write = {}, retrieval.work_table

    def kept(df, name):
        held[name] = write(df, name)
        return held[name]

    monkeypatch.setattr(retrieval, "work_table", kept)
    sets = spark.createDataFrame([(1, ["a", "b", "c", "d"]), (2, ["d", "c", "b", "a"]), (3, ["a", "b", "c", "d", "e"]), (4, ["x"])], "id long, tokens array<string>")
    assert [tuple(r) for r in retrieval.similar_sets(sets).collect()] == [(1, 3, 0.8)]
    assert dict(held["token-sets"].dtypes)["tokens"] == "array<bigint>"
    order = [r.token for r in held["token-ranks"].orderBy("rank").collect()]
    assert order == ["e", "x", "a", "b", "c", "d"]
