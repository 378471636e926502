"""Retrieval, evidence and text queries, with SQL where it can express them."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import curation, text
from ..operators import chunks, evidence, lexical, maintenance, retrieval, temporal
from ..sources.work import shared_folder, small_table, work_table
from ..sources.tables import read

QUERIES, ORACLES = {}, {}


def query(sql=None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


def corpus(s, d):
    return read(s, d, "documents").select(F.col("doc_id").alias("idx"), "text")


def questions(s, d):
    return read(s, d, "benchmark").select(F.col("item_id").alias("query_id"), "text")


FOLD = lambda c: f"replace(lower(strip_accents({c})), 'ß', 'ss')"
CUT = r"'[\p{L}\p{N}_]+(?:[-_.][\p{L}\p{N}_]+)*'"
TOKENS = lambda c: (
    f"list_concat(list_transform(list_filter(regexp_extract_all(replace(lower(nfc_normalize({c})), 'ß', 'ss'), {CUT}), lambda x: length(x) > 1), lambda x: 'raw:' || x),"
    f" list_transform(list_filter(regexp_extract_all({FOLD(c)}, {CUT}), lambda x: length(x) > 1), lambda x: 'fold:' || x))"
)


@query(f"SELECT doc_id AS idx, len({TOKENS('text')}) AS n_tokens, sha256(array_to_string({TOKENS('text')}, ' ')) AS digest FROM documents")
def bm25_tokens(s, d):
    t = corpus(s, d).select("idx", text.channel_tokens(F.col("text")).alias("t"))
    return t.select("idx", F.size("t").cast("long").alias("n_tokens"), F.sha2(F.array_join("t", " "), 256).alias("digest"))


POST = f"""cut AS MATERIALIZED (SELECT doc_id AS idx, {TOKENS('text')} AS tokens FROM documents),
post AS MATERIALIZED (SELECT idx, token, count(*) AS tf FROM (SELECT idx, unnest(tokens) AS token FROM cut) GROUP BY 1, 2),
size AS (SELECT (SELECT count(*) FROM documents) AS n, (SELECT sum(tf) FROM post) AS total),
lens AS (SELECT idx, sum(tf) AS dl FROM post GROUP BY 1),
dfs AS MATERIALIZED (SELECT token, count(*) AS df, ln((SELECT n FROM size) - count(*) + 0.5::DOUBLE) - ln(count(*) + 0.5::DOUBLE) AS raw FROM post GROUP BY 1),
idf AS (SELECT token, df, CASE WHEN raw < 0 THEN 0.25::DOUBLE * (SELECT avg(raw) FROM dfs) ELSE raw END AS idf FROM dfs)"""
SPARSE = f"""terms AS (SELECT query_id, token, count(*) AS qf FROM (SELECT item_id AS query_id, unnest({TOKENS('text')}) AS token FROM benchmark) GROUP BY 1, 2),
scored AS (SELECT query_id, idx, round(sum(qf * idf * tf * 2.5::DOUBLE / (tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / ((SELECT total FROM size)::DOUBLE / (SELECT n FROM size))))), 6) AS bm25_score
  FROM post JOIN terms USING (token) JOIN idf USING (token) JOIN lens USING (idx) GROUP BY 1, 2),
sparse AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY bm25_score DESC, idx) AS bm25_rank FROM scored WHERE bm25_score > 0) WHERE bm25_rank <= 30)"""
DENSE = lambda q: f"""dense AS (SELECT query_id, idx, dense_score, row_number() OVER (PARTITION BY query_id ORDER BY dense_score DESC, idx) AS dense_rank
  FROM (SELECT q.vec_id AS query_id, e.vec_id AS idx, round(list_inner_product(e.embedding::DOUBLE[], q.embedding::DOUBLE[]), 6) AS dense_score FROM embeddings e, embeddings q WHERE {q})
  QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY dense_score DESC, idx) <= 30)"""  # noqa: E731


@query(f"WITH {POST} SELECT token, df, round(idf, 6) AS idf FROM idf")
def bm25_stats(s, d):
    words = lexical.build(corpus(s, d))["words"]
    return lexical.stats(words, read(s, d, "documents").count()).select("token", "df", F.round("idf", 6).alias("idf"))


@query(f"WITH {POST}, {SPARSE} SELECT query_id, idx, bm25_score, bm25_rank FROM sparse")
def bm25_topk(s, d):
    return retrieval.bm25_top(questions(s, d), corpus(s, d))


#: After three batches: a quarter of the documents came later, a fifth went, and half of that came back with their source.
FINAL = "(SELECT doc_id, CASE WHEN doc_id % 10 = 0 THEN source || ' ' || coalesce(text, '') ELSE text END AS text FROM documents WHERE doc_id % 5 <> 0 OR doc_id % 10 = 0) AS final"


def _maintained(s, d):
    """The folder of an index of documents after a first build and three batches of changes."""
    root = f"{shared_folder(s)}/maintained-{uuid.uuid4().hex}"
    docs = read(s, d, "documents").select(F.col("doc_id").alias("idx"), "doc_id", "text", "source")
    maintenance.apply(root, docs.filter("doc_id % 4 <> 3"))
    maintenance.apply(root, docs.filter("doc_id % 4 = 3"))
    maintenance.apply(root, docs.limit(0), docs.filter("doc_id % 5 = 0").select("doc_id"))
    again = F.concat("source", F.lit(" "), F.coalesce("text", F.lit("")))
    maintenance.apply(root, docs.filter("doc_id % 10 = 0").withColumn("text", again))
    return root


@query(f"WITH {POST} SELECT token, df, round(idf, 6) AS idf FROM idf".replace("FROM documents", f"FROM {FINAL}"))
def maintained_stats(s, d):
    index = maintenance.load(s, _maintained(s, d))
    return lexical.stats(index["words"], index["totals"].first()["documents"]).select("token", "df", F.round("idf", 6).alias("idf"))


@query(f"WITH {POST}, {SPARSE} SELECT query_id, idx, bm25_score, bm25_rank FROM sparse".replace("FROM documents", f"FROM {FINAL}"))
def maintained_topk(s, d):
    return retrieval.bm25_top(questions(s, d), None, index=maintenance.load(s, _maintained(s, d)))


@query()
def bm25_skips(s, d):
    """How many blocks of the index hold terms of a question, and of how many the postings are read."""
    return lexical.skipped(questions(s, d), lexical.build(corpus(s, d)), retrieval.TOP_K)


def vectors(s, d):
    return read(s, d, "embeddings").select(F.col("vec_id").alias("idx"), F.col("embedding").alias("vector"))


@query(f"WITH {DENSE('q.vec_id % 100 = 0')} SELECT * FROM dense")
def dense_topk(s, d):
    v = vectors(s, d)
    return retrieval.dense_top(v.filter("idx % 100 = 0").select(F.col("idx").alias("query_id"), "vector"), v)


def _both(s, d):
    """Dense and lexical hits of every benchmark item; its vector is the one of its number."""
    v = vectors(s, d)
    q = v.join(read(s, d, "benchmark").select(F.col("item_id").alias("idx")), "idx", "left_semi")
    return retrieval.dense_top(q.select(F.col("idx").alias("query_id"), "vector"), v), retrieval.bm25_top(questions(s, d), corpus(s, d))


BOTH = f"WITH {POST}, {SPARSE}, {DENSE('q.vec_id IN (SELECT item_id FROM benchmark)')}"


@query(
    f"{BOTH} SELECT query_id, coalesce(dense_score, 0) AS best_dense, coalesce(bm25_score, 0) AS best_bm25, coalesce(dense_score, 0) >= 1.1 OR coalesce(bm25_score, 0) >= 120 AS passed"
    " FROM (SELECT query_id, dense_score FROM dense WHERE dense_rank = 1) FULL JOIN (SELECT query_id, bm25_score FROM sparse WHERE bm25_rank = 1) USING (query_id)"
)
def confidence_gate(s, d):
    return retrieval.confident(*_both(s, d), min_dense=1.1, min_bm25=120.0)


FUSED = f"""{BOTH}, fused AS (SELECT query_id, idx, dense_rank, bm25_rank, round(coalesce(0.5::DOUBLE / (60 + dense_rank), 0) + coalesce(0.5::DOUBLE / (60 + bm25_rank), 0), 12) AS combined_score
  FROM dense FULL JOIN sparse USING (query_id, idx))"""


@query(
    f"{FUSED} SELECT query_id, idx, dense_rank, bm25_rank, combined_score, dense_rank IS NOT NULL AND bm25_rank IS NOT NULL AS matched_both,"
    " row_number() OVER (PARTITION BY query_id ORDER BY combined_score DESC, dense_rank NULLS LAST, bm25_rank NULLS LAST) AS fused_rank FROM fused"
)
def rrf_fusion(s, d):
    out = retrieval.fuse(*_both(s, d))
    return out.select("query_id", "idx", "dense_rank", "bm25_rank", "combined_score", "matched_both", "fused_rank")


def _metadata(s, d):
    docs = read(s, d, "documents")
    heading = F.substring(F.element_at(F.split("text", "\n", -1), 1), 1, 180)
    return docs.select(F.col("doc_id").alias("idx"), "source", heading.alias("heading"), F.concat_ws(" > ", "source", heading).alias("section_path"), "text")


def _boosted(s, d):
    dense, sparse = _both(s, d)
    return retrieval.boost(retrieval.fuse(dense, sparse), questions(s, d), _metadata(s, d))


SQUEEZED = lambda c: f"trim(regexp_replace({FOLD(c)}, '\\s+', ' ', 'g'))"
#: Identifiers: codes first, and long numbers in what they leave. Separators are doubled, as the patterns of this dialect
#: look at neither side of a match.
CODE = "(^|[^\\p{L}\\p{N}_])([A-Za-z]{1,12}[-_.]?[A-Za-z0-9]*[0-9]+[A-Za-z0-9_.-]*)($|[^\\p{L}\\p{N}_])"
DOUBLED = lambda c: f"regexp_replace({c}, '([^\\p{{L}}\\p{{N}}_.-])', '\\1\\1', 'g')"
LEFT_OVER = lambda c: f"regexp_replace(regexp_replace({DOUBLED(c)}, '{CODE}', '\\1 \\3', 'g'), '([^\\p{{L}}\\p{{N}}_])', '\\1\\1', 'g')"
CODES_SQL = lambda c: (
    f"list_transform(list_concat(regexp_extract_all({DOUBLED(c)}, '{CODE}', 2), regexp_extract_all({LEFT_OVER(c)}, '(^|[^\\p{{L}}\\p{{N}}_])([0-9]{{3,}})($|[^\\p{{L}}\\p{{N}}_])', 2)), lambda x: lower(x))"
)
IDENTIFIERS_SQL = lambda c, folded: f"list_sort(list_distinct(list_concat({CODES_SQL(c)}, list_filter({list(text.DOMAIN_TERMS)}, lambda t: contains({folded}, t)))))"
TOKEN_SET_SQL = lambda c: f"list_distinct(list_filter(regexp_extract_all({c}, '[\\p{{L}}\\p{{N}}_]+'), lambda x: length(x) > 1 AND NOT list_contains({list(text.STOPWORDS)}, x)))"
PRESENT = {k: f"(contains(s, '{a}') OR contains(s, '{b}'))" for k, (a, b) in curation.INTENT_WORDS.items()}


@query(
    f"""{FUSED}, ranked AS (SELECT query_id, idx, combined_score, row_number() OVER (PARTITION BY query_id ORDER BY combined_score DESC, dense_rank NULLS LAST, bm25_rank NULLS LAST) AS fused_rank FROM fused),
folded AS (SELECT item_id AS query_id, text, {SQUEEZED('text')} AS q FROM benchmark),
asked AS (SELECT query_id, q, {IDENTIFIERS_SQL('text', 'lower(text)')} AS wanted, {TOKEN_SET_SQL('q')} AS tokens,
  CASE WHEN contains(q, 'pea') OR regexp_matches(q, '\\bthi\\s+thuc\\s+hanh\\b') THEN 'pea' WHEN contains(q, 'eos') OR contains(q, 'ly thuyet') THEN 'eos' WHEN contains(q, 'e360') OR contains(q, 'speaking') THEN 'e360' END AS asked FROM folded),
titled AS (SELECT doc_id AS idx, source, text, left(string_split(text, chr(10))[1], 180) AS heading FROM documents),
placed AS (SELECT idx, source, heading, text, concat_ws(' > ', source, heading) AS path FROM titled),
texts AS MATERIALIZED (SELECT idx, {SQUEEZED("concat_ws(' ', source, heading, path, text)")} AS s, {TOKEN_SET_SQL(SQUEEZED("concat_ws(' ', heading, path)"))} AS h FROM placed WHERE idx IN (SELECT idx FROM ranked)),
hits AS (SELECT r.*, a.*, t.s, t.h, list_filter(a.wanted, lambda w: contains(t.s, w)) AS matched FROM ranked r JOIN asked a USING (query_id) JOIN texts t USING (idx)),
rules AS (SELECT query_id, idx, fused_rank, combined_score,
  CASE WHEN asked IS NULL THEN 1.0::DOUBLE WHEN {" OR ".join(f"(asked = '{k}' AND {p})" for k, p in PRESENT.items())} THEN 1.12::DOUBLE WHEN {" OR ".join(PRESENT.values())} THEN 0.88::DOUBLE ELSE 1.0::DOUBLE END AS product,
  len(wanted) > 0 AND len(matched) = len(wanted) AS every_id, len(matched) > 0 AND len(matched) < len(wanted) AS some_id,
  len(string_split(q, ' ')) BETWEEN 3 AND 24 AND contains(s, q) AS phrase, len(tokens) > 0 AND len(list_intersect(tokens, h)) / len(tokens) >= 0.5 AS head FROM hits),
ruled AS (SELECT query_id, idx, fused_rank, combined_score, every_id, some_id, phrase, head, least(greatest(product * CASE WHEN every_id THEN 1.25::DOUBLE WHEN some_id THEN 1.10::DOUBLE ELSE 1.0::DOUBLE END
  * CASE WHEN phrase THEN 1.15::DOUBLE ELSE 1.0::DOUBLE END * CASE WHEN head THEN 1.08::DOUBLE ELSE 1.0::DOUBLE END, 0.80::DOUBLE), 1.45::DOUBLE) AS rule_factor FROM rules),
boosted AS (SELECT query_id, idx, fused_rank, round(combined_score * rule_factor, 12) AS combined_score, rule_factor, concat_ws(',', CASE WHEN every_id THEN 'all_identifiers' END, CASE WHEN some_id THEN 'some_identifiers' END,
  CASE WHEN phrase THEN 'exact_phrase' END, CASE WHEN head THEN 'heading_match' END) AS boost_reasons FROM ruled)
SELECT query_id, idx, combined_score, rule_factor, boost_reasons, row_number() OVER (PARTITION BY query_id ORDER BY combined_score DESC, fused_rank) AS boost_rank FROM boosted QUALIFY boost_rank <= 15"""
)
def rule_boost(s, d):
    return _boosted(s, d).select("query_id", "idx", "combined_score", "rule_factor", F.array_join("boost_reasons", ",").alias("boost_reasons"), "boost_rank")


#: Children of a document are numbered below this.
PER_DOCUMENT = 100_000


def _children(s, d):
    """Chunks of all documents as a corpus for retrieval: a source is a guide, its documents are the pages, each one a step of seven."""
    docs = read(s, d, "documents").select("doc_id", "source", "text")
    pages = work_table(chunks.page_numbers(docs).select("doc_id", "source", "page"), "pages")
    step = ((F.col("page") - 1) % 7 + 1).cast("string")
    # Documents without a source are in no guide.
    rows = docs.filter("source is not null").join(pages.drop("source"), "doc_id").select("doc_id", "source", "page", F.concat(F.lit("Bước "), step, F.lit(": "), F.col("text")).alias("content"))
    found = chunks.chunk_pages(rows.filter("content is not null"), key="doc_id")
    # The text for retrieval is the path and the text, so it is not written beside them.
    written = work_table(found.drop("retrieval_text").withColumn("idx", F.col("doc_id") * PER_DOCUMENT + F.col("position")), "children")
    return written.withColumn("retrieval_text", F.concat("section_path", F.lit("\n"), "text"))


def _asked(s, d):
    """The questions as they are searched for; what is empty then is no question."""
    return questions(s, d).select("query_id", text.normalize_query(F.col("text")).alias("text")).filter("text <> ''")


def _parents(s, d, gate=False, children=None):
    """Parents of the hits of every benchmark item; a vector stands for the first child of its document."""
    c = children if children is not None else _children(s, d)
    asked = _asked(s, d)
    v = vectors(s, d).withColumn("idx", F.col("idx") * PER_DOCUMENT).join(c.select("idx"), "idx", "left_semi")
    q = vectors(s, d).join(asked.select(F.col("query_id").alias("idx")), "idx", "left_semi")
    dense = work_table(retrieval.dense_top(q.select(F.col("idx").alias("query_id"), "vector"), v), "dense")
    sparse = work_table(retrieval.bm25_top(asked, c.select("idx", F.col("retrieval_text").alias("text"))), "sparse")
    fused = retrieval.fuse(dense, sparse)
    if gate:
        fused = fused.join(retrieval.confident(dense, sparse, 1.1, 100.0).filter("passed").select("query_id"), "query_id", "left_semi")
    # Only children that are hits go on: a few numbers are broadcast, and the texts of all others are not shuffled.
    fused = work_table(fused, "fused")
    c = work_table(c.join(work_table(fused.select("idx").distinct(), "fused-places"), "idx", "left_semi"), "hit-children")
    corpus = c.select("idx", "source", "heading", "section_path", F.col("retrieval_text").alias("text"))
    boosted = retrieval.boost(fused, asked, corpus).select("query_id", "idx", F.col("boost_rank").alias("rank"), "combined_score")
    kids = boosted.join(c.select("idx", "parent_id", "source", "page", "heading", "section_path", F.col("parent_text").alias("content")), "idx")
    return retrieval.roll_up(kids.drop("idx"))


@query(
    f"{FUSED}, kids AS (SELECT query_id, source AS parent_id, combined_score, text, row_number() OVER (PARTITION BY query_id ORDER BY combined_score DESC, dense_rank NULLS LAST, bm25_rank NULLS LAST) AS rank"
    " FROM fused JOIN documents ON doc_id = idx) SELECT query_id, parent_id, round(max(combined_score) * (1 + 0.10::DOUBLE * ln(1 + least(count(*) - 1, 3))), 9) AS score, count(*) AS matched, sha256(arg_min(text, rank)) AS digest FROM kids GROUP BY 1, 2"
)
def parent_rollup(s, d):
    fused = retrieval.fuse(*_both(s, d)).join(read(s, d, "documents").select(F.col("doc_id").alias("idx"), "source", "text"), "idx")
    kids = fused.select("query_id", F.col("source").alias("parent_id"), F.col("fused_rank").alias("rank"), "combined_score", F.col("text").alias("content"), "source")
    return retrieval.roll_up(kids).select("query_id", "parent_id", F.round("combined_score", 9).alias("score"), "matched", F.sha2("content", 256).alias("digest"))


@query()
def greedy_select(s, d):
    return evidence.select_evidence(_parents(s, d))


@query()
def evidence_context(s, d):
    return evidence.context(evidence.select_evidence(_parents(s, d)))


def _editions(s, d):
    """Versions by document: documents of a source with one first line are editions of a text.

    The tables hold no dated names, so the day of an edition is made up from its doc_id.
    """
    first = F.nullif(F.trim(F.element_at(F.split("text", "\n", 2), 1)), F.lit(""))
    docs = read(s, d, "documents").select(
        "doc_id", "source", F.sha2(F.concat_ws("\n", "source", first), 256).alias("family_id"),
        F.date_add(F.lit("2015-01-01").cast("date"), (F.col("doc_id") % 3650).cast("int")).cast("string").alias("day"), first.isNotNull().alias("named"),
    )
    docs = docs.filter("named").drop("named")
    ranked = temporal.version_ranks(docs.select("family_id", "day").distinct())
    return docs.join(ranked, ["family_id", "day"]).withColumns({"temporal_status": F.lit("verified"), "verified_visual_fact": F.lit(None).cast("string")})


def _selected(s, d):
    """Evidence of every question by the whole path, and the children that it comes from.

    Questions are normalised; two retrievals, gate, fusion, boosts, parents, choice between versions and selection follow.
    """
    c = _children(s, d)
    places = c.select("doc_id", "page").distinct()
    editions = work_table(_editions(s, d).join(places, "doc_id").drop("doc_id"), "editions")
    families = temporal.catalog(editions)
    newest = editions.join(families, "family_id").filter("version_rank = newest_rank").select("family_id", "version_rank", "day", "source", "page")
    pages = c.select(F.col("parent_id").alias("cand_id"), "source", "page", "heading", "section_path", F.col("parent_text").alias("content"))
    newest = pages.join(newest, ["source", "page"]).dropDuplicates(["cand_id"])
    none = small_table(s, "source string, family_id string, day string, version_rank int, temporal_status string")
    parents = temporal.enrich(_parents(s, d, True, c).withColumnRenamed("content", "text"), none, editions)
    parents = parents.join(_asked(s, d).select("query_id", F.col("text").alias("query")), "query_id").select(
        "query_id", "query", "family_id", "version_rank", "day", F.col("parent_id").alias("cand_id"), "source", "page", "heading", "section_path",
        F.col("text").alias("content"), F.col("combined_score").alias("score"), F.col("parent_rank").alias("position"), "matched",
    )
    found = temporal.resolve(parents, families, newest).withColumnsRenamed({"cand_id": "parent_id", "score": "combined_score", "rank": "parent_rank"})
    return evidence.select_evidence(found.drop("query", "position")), c


@query()
def retrieve_context(s, d):
    """The text that each question is answered from."""
    return evidence.context(_selected(s, d)[0])


@query()
def retrieve_sources(s, d):
    """The list of evidence behind each text, with versions, actions and the pages of procedures."""
    chosen, children = _selected(s, d)
    procedures = evidence.procedure_catalogue(children.select("source", "section_path", "heading", "page", "parent_text", "text"))
    return evidence.source_documents(chosen, procedures)


SETS = rf"sets AS (SELECT list_sort(list_distinct(regexp_extract_all({FOLD('text')}, '[\p{{L}}\p{{N}}_]+'))) AS t, min(doc_id) AS id FROM documents GROUP BY 1)"


@query(
    f"WITH {SETS}, p AS (SELECT a.id AS left, b.id AS right, len(list_intersect(a.t, b.t)) AS c, len(a.t) AS x, len(b.t) AS y FROM sets a JOIN sets b ON a.id < b.id"
    " AND least(len(a.t), len(b.t)) >= 0.78 * greatest(len(a.t), len(b.t)))"
    ' SELECT "left", "right", round(c / (x + y - c), 6) AS jaccard FROM p WHERE c / (x + y - c) >= 0.78'
)
def near_dup_pairs(s, d):
    words = F.array_distinct(F.regexp_extract_all(text.fold_ws("text"), F.lit(text.WORDS), 0))
    sets = read(s, d, "documents").select(F.col("doc_id").alias("id"), words.alias("tokens"))
    return retrieval.similar_sets(sets).withColumn("jaccard", F.round("jaccard", 6))


@query(f"WITH {SETS.replace('min(doc_id) AS id', 'list(doc_id) AS ids, min(doc_id) AS class_id')} SELECT unnest(ids) AS id, class_id FROM sets")
def near_dup_classes(s, d):
    """Membership of all documents in the classes that near_dup_pairs links."""
    words = F.array_distinct(F.regexp_extract_all(text.fold_ws("text"), F.lit(text.WORDS), 0))
    return retrieval.set_classes(read(s, d, "documents").select(F.col("doc_id").alias("id"), words.alias("tokens")))


WORD_LIST = r"regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')"


@query(
    f"WITH w AS (SELECT doc_id AS id, {WORD_LIST} AS w FROM documents), g AS (SELECT id, len(w) AS size, n, list_aggregate(w[i:i + n - 1], 'string_agg', ' ') AS run"
    " FROM w, unnest(range(3, 9)) AS t(n), unnest(range(1, len(w) - n + 2)) AS u(i) WHERE len(w) >= 24),"
    " c AS (SELECT id, size, n, max(c) AS most FROM (SELECT id, size, n, run, count(*) AS c FROM g GROUP BY ALL) GROUP BY ALL)"
    " SELECT id, CAST(n AS INT) AS n, most, most >= 4 AND most * n >= greatest(18, size // 4) AS repeated FROM c"
)
def repeated_ngrams(s, d):
    return evidence.repeated_sequences(read(s, d, "documents").select(F.col("doc_id").alias("id"), "text"))


@query("SELECT conv_id, turn, " + "CASE " + " ".join("WHEN " + " OR ".join(f"contains(lower(text), '{w}')" for w in words) + f" THEN '{name}'" for name, words in curation.TOPIC_RULES) + " ELSE 'General Guidance' END AS topic FROM conversations WHERE role = 'user'")
def topic_classify(s, d):
    return read(s, d, "conversations").filter("role = 'user'").select("conv_id", "turn", curation.topic(F.col("text")).alias("topic"))


@query(f"SELECT doc_id, CASE WHEN contains(f, 'pea') OR regexp_matches(f, '\\bthi\\s+thuc\\s+hanh\\b') THEN 'pea' WHEN contains(f, 'eos') OR contains(f, 'ly thuyet') THEN 'eos' WHEN contains(f, 'e360') OR contains(f, 'speaking') THEN 'e360' END AS intent FROM (SELECT doc_id, {FOLD('text')} AS f FROM documents)")
def question_intent(s, d):
    folded = read(s, d, "documents").select("doc_id", text.fold_ws("text").alias("f"))
    return folded.select("doc_id", curation.intent(F.col("f")).alias("intent"))


@query(f"SELECT doc_id, array_to_string({IDENTIFIERS_SQL('text', 'lower(text)')}, ' ') AS identifiers FROM documents")
def query_identifiers(s, d):
    docs = read(s, d, "documents")
    return docs.select("doc_id", F.array_join(text.identifiers(F.col("text"), F.lower("text")), " ").alias("identifiers"))


@query("SELECT conv_id, turn, trim(regexp_replace(regexp_replace(replace(nfc_normalize(text), chr(160), ' '), '[\\x00-\\x1f\\x7f]+', ' ', 'g'), '\\s+', ' ', 'g')) AS text FROM conversations")
def normalize_query(s, d):
    return read(s, d, "conversations").select("conv_id", "turn", text.normalize_query(F.col("text")).alias("text"))


@query("SELECT doc_id, array_to_string(list_filter(list_transform(string_split(replace(nfc_normalize(text), chr(160), ' '), chr(10)), lambda x: trim(regexp_replace(x, '[ \\t]+', ' ', 'g'))), lambda x: x <> ''), chr(10)) AS text FROM documents")
def clean_page_text(s, d):
    return read(s, d, "documents").select("doc_id", text.clean_page(F.col("text")).alias("text"))


@query("SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS page, length(text) AS n FROM documents")
def corpus_pages(s, d):
    docs = read(s, d, "documents")
    pages = chunks.page_numbers(docs).select("doc_id", "page")
    return docs.select("source", "doc_id", F.length("text").cast("long").alias("n")).join(pages, "doc_id")


@query()
def chunk_index(s, d):
    docs = read(s, d, "documents")
    pages = chunks.page_numbers(docs).select("doc_id", "page")
    return chunks.chunk_pages(docs.select("doc_id", "source", F.col("text").alias("content")).join(pages, "doc_id"))


LINES_SQL = "string_split_regex(coalesce(text, ''), '\\r\\n|[\\n\\r\\x0b\\x0c\\x1c-\\x1e\\x{85}\\x{2028}\\x{2029}]')[1:6]"
LEAD_SQL = "(?i)^(?:" + "|".join(chunks.HEADING_WORDS) + ")($|[^\\p{L}\\p{N}_])|^[0-9]+[.)][\\p{L}\\p{N}_]"


@query(
    f"WITH l AS (SELECT doc_id, list_transform({LINES_SQL}, lambda x: regexp_replace(x, '\\s+', ' ', 'g')) AS single FROM documents),"
    " b AS (SELECT doc_id, single, list_transform(single, lambda x: regexp_replace(x, '^[ \\-•]+|[ \\-•]+$', '', 'g')) AS bare FROM l)"
    " SELECT doc_id, coalesce(list_filter(bare, lambda x: length(x) BETWEEN 1 AND 180 AND ((regexp_matches(x, '\\p{L}') AND len(regexp_extract_all(x, '\\p{Lu}')) >= 0.55 * len(regexp_extract_all(x, '\\p{L}')))"
    f" OR regexp_matches(x, '{LEAD_SQL}')))[1], trim(left(single[1], 180), ' ')) AS heading FROM b"
)
def page_heading(s, d):
    return read(s, d, "documents").select("doc_id", chunks.page_heading(F.col("text")).alias("heading"))


#: Answers with citations in several spellings, made of the assistants' turns, and evidence for each.
def _answers(s, d):
    t = read(s, d, "conversations").filter("role = 'assistant' and text is not null")
    half = F.floor(F.length("text") / 2).cast("int")
    mark = lambda shift: ((F.col("turn") + F.col("conv_id") + shift) % 5 + 1).cast("string")
    answer = F.concat(
        F.substring("text", F.lit(1), half), F.lit(" [Sử dụng E"), mark(0), F.lit("] , "), F.expr("substring(text, floor(length(text) / 2) + 1)"), F.lit("  [nguồn : e"), mark(1),
        F.lit("]\n\n\n\nxem [E"), mark(3), F.lit("][Evidence E"), mark(0), F.lit("] ."),
    )
    return t.select((F.col("conv_id") * 1000 + F.col("turn")).alias("answer_id"), answer.alias("answer"))


ANSWERS_SQL = """turns AS (SELECT conv_id * 1000 + turn AS answer_id, text, CAST(floor(length(text) / 2) AS BIGINT) AS half, turn + conv_id AS k FROM conversations WHERE role = 'assistant' AND text IS NOT NULL),
answers AS (SELECT answer_id, left(text, half) || ' [Sử dụng E' || (k % 5 + 1) || '] , ' || substr(text, half + 1) || '  [nguồn : e' || ((k + 1) % 5 + 1) || ']' || repeat(chr(10), 4)
  || 'xem [E' || ((k + 3) % 5 + 1) || '][Evidence E' || (k % 5 + 1) || '] .' AS answer FROM turns)"""
NORMAL_SQL = r"regexp_replace(answer, '\[\s*(?:(?:sử dụng|nguồn|tham khảo|evidence)\s*:?\s*)?E\s*(\d+)\s*\]', '[E\1]', 'gi')"
STRIP_SQL = NORMAL_SQL
for pattern, new in ((r"\[[Ee]\d+\]", ""), (r"[ \t]+(\n|$)", r"\1"), (" {2,}", " "), (r"\s+([,.;:!?])", r"\1"), (r"\n{3,}", "__NL2__")):
    STRIP_SQL = f"regexp_replace({STRIP_SQL}, '{pattern}', " + ("chr(10) || chr(10)" if new == "__NL2__" else f"'{new}'") + ", 'g')"


@query(f"WITH {ANSWERS_SQL} SELECT answer_id, {NORMAL_SQL} AS normal, array_to_string(list_transform(regexp_extract_all({NORMAL_SQL}, '\\[[Ee](\\d+)\\]', 1), lambda n: 'E' || n), ',') AS ids, trim({STRIP_SQL}, ' ' || chr(10)) AS plain FROM answers")
def citations(s, d):
    a = F.col("answer")
    return _answers(s, d).select("answer_id", curation.normalise_citations(a).alias("normal"), F.array_join(curation.cited(a), ",").alias("ids"), curation.strip_citations(a).alias("plain"))


def _evidence(s, d):
    """Four pieces of evidence for each answer, some without a score or below zero."""
    rows = _answers(s, d).select("answer_id", F.explode(F.sequence(F.lit(1), F.lit(4))).alias("i"))
    score = F.when((F.col("answer_id") + F.col("i")) % 7 != 0, ((F.col("answer_id") * 7 + F.col("i") * 3) % 11 - 2) / 100)
    return rows.select("answer_id", F.concat(F.lit("e"), F.col("i").cast("string")).alias("evidence_id"), F.concat(F.lit("f"), ((F.col("answer_id") + F.col("i")) % 3).cast("string"), F.lit(".pdf")).alias("file_name"), score.alias("score"))


@query(
    f"WITH {ANSWERS_SQL}, ev AS (SELECT answer_id, 'E' || i AS evidence_id, 'f' || ((answer_id + i) % 3) || '.pdf' AS file_name, CASE WHEN (answer_id + i) % 7 <> 0 THEN ((answer_id * 7 + i * 3) % 11 - 2) / 100 END AS score FROM answers, range(1, 5) AS r(i)),"
    f" ids AS (SELECT answer_id, list_transform(regexp_extract_all({NORMAL_SQL}, '\\[[Ee](\\d+)\\]', 1), lambda n: 'E' || n) AS l FROM answers),"
    " c AS (SELECT answer_id, l[i] AS evidence_id, min(i) AS position FROM ids, unnest(range(1, len(l) + 1)) AS t(i) GROUP BY 1, 2),"
    " f AS (SELECT answer_id, file_name, round(sum(greatest(coalesce(score, 0), 0)), 9) AS total, count(*) AS n, max(greatest(coalesce(score, 0), 0)) AS best, min(position) AS first"
    " FROM c JOIN ev USING (answer_id, evidence_id) GROUP BY 1, 2)"
    " SELECT answer_id, file_name FROM f QUALIFY row_number() OVER (PARTITION BY answer_id ORDER BY total DESC, n DESC, best DESC, first) = 1"
)
def primary_source(s, d):
    cited = _answers(s, d).select("answer_id", F.posexplode(curation.cited(F.col("answer"))).alias("position", "evidence_id"))
    return evidence.primary_source(cited, _evidence(s, d))


ISLANDS = """m AS (SELECT *, CASE WHEN lag(page) OVER w IS NULL OR page - lag(page) OVER w > 2 OR list_min(steps) <= lag(list_max(steps)) OVER w THEN 1 ELSE 0 END AS new FROM st WINDOW w AS (PARTITION BY source, section ORDER BY page)),
g AS (SELECT *, sum(new) OVER (PARTITION BY source, section ORDER BY page) AS island FROM m)"""
#: Pages of procedures: the parts of an order are steps on the page of its day, for each kind of customer.
STEPS_SQL = """st AS (SELECT 'guide ' || (l_partkey % 500) AS source, l_linestatus || l_returnflag AS section, CAST(l_orderkey % 60 AS INT) AS page, array_agg(DISTINCT CAST(l_linenumber + l_orderkey % 60 // 2 AS INT)) AS steps FROM lineitem GROUP BY ALL)"""


def _steps(s, d):
    page = (F.col("l_orderkey") % 60).cast("int")
    step = (F.col("l_linenumber") + F.floor(F.col("l_orderkey") % 60 / 2)).cast("int")
    rows = read(s, d, "lineitem").select(F.concat(F.lit("guide "), (F.col("l_partkey") % 500).cast("string")).alias("source"), F.concat("l_linestatus", "l_returnflag").alias("section"), page.alias("page"), step.alias("step"))
    return rows.groupBy("source", "section", "page").agg(F.collect_set("step").alias("steps"))


@query(f"WITH {STEPS_SQL}, {ISLANDS}, w AS (SELECT source, section, island, string_agg(page::VARCHAR, ',' ORDER BY page) AS pages FROM g GROUP BY ALL) SELECT source, section, page, pages FROM g JOIN w USING (source, section, island)")
def procedural_pages(s, d):
    found = evidence.procedural_pages(_steps(s, d))
    return found.select("source", "section", "page", F.array_join(F.col("group_pages").cast("array<string>"), ",").alias("pages"))


@query(
    "WITH st AS (SELECT l_suppkey AS source, lower(l_returnflag) AS section, CAST(l_orderkey % 200 AS INT) AS page, array_agg(DISTINCT l_linenumber) AS steps FROM lineitem GROUP BY ALL),"
    f" {ISLANDS} SELECT CAST(source AS VARCHAR) AS source, section, page, (SELECT string_agg(h.page::VARCHAR, ',' ORDER BY h.page) FROM g h WHERE h.source = g.source AND h.section = g.section AND h.island = g.island) AS pages FROM g"
)
def procedure_catalogue(s, d):
    """Order lines as step chunks: a supplier is a source, a return flag its section."""
    l = read(s, d, "lineitem")
    number = F.col("l_linenumber").cast("string")
    rows = l.select(
        F.col("l_suppkey").cast("string").alias("source"),
        F.concat(F.col("l_returnflag"), F.lit(" > Bước "), number, F.lit(": part > rest")).alias("section_path"),
        F.lit(None).cast("string").alias("heading"),
        (F.col("l_orderkey") % 200).alias("page"),
        F.concat(F.lit("Then  BƯỚC "), number, F.lit(" ends; step7x does not count")).alias("parent_text"),
        F.lit("").alias("text"),
    )
    return evidence.procedure_catalogue(rows).select("source", "section", "page", F.array_join(F.col("group_pages").cast("array<string>"), ",").alias("pages"))


@query(f"WITH {STEPS_SQL}, {ISLANDS} SELECT DISTINCT g.page AS answer_id, g.source AS file_name, h.page FROM g JOIN g h USING (source, section, island) WHERE list_min(g.steps) % 3 = 0")
def page_refs(s, d):
    """Pages of whole procedures that answers rest on: an answer for each page number, from chunks whose first step is a third."""
    found = evidence.procedural_pages(_steps(s, d)).filter(F.array_min("steps") % 3 == 0)
    return evidence.page_references(found.select(F.col("page").alias("answer_id"), F.col("source").alias("file_name"), "page", F.col("group_pages").alias("procedural_pages")))


SPOKEN = ("vào phòng  thu mở WIFI ngay", "trong phòng thử và Usb", "giám thi nói wifi6 rồi", "khảo thí, EOSClient; giam thi!", "không có gì")
SPOKEN_SQL = "(" + str(list(SPOKEN)) + ")[(turn + conv_id) % 5 + 1]"


def _spoken(s, d):
    said = F.element_at(F.array(*map(F.lit, SPOKEN)), ((F.col("turn") + F.col("conv_id")) % 5 + 1).cast("int"))
    return read(s, d, "conversations").filter("text is not null").withColumn("said", said)


FIXED_SQL = f"trim(regexp_replace({SPOKEN_SQL} || ' ' || text || '  ' || {SPOKEN_SQL}, '\\s+', ' ', 'g'))"
for wrong, right in curation.VOICE_FIXES:
    FIXED_SQL = f"regexp_replace({FIXED_SQL}, '(^|[^\\p{{L}}\\p{{N}}_]){wrong}($|[^\\p{{L}}\\p{{N}}_])', '\\1{right}\\2', 'gi')"


@query(f"SELECT conv_id, turn, {FIXED_SQL} AS fixed FROM conversations WHERE text IS NOT NULL")
def voice_fixes(s, d):
    t = _spoken(s, d)
    return t.select("conv_id", "turn", curation.voice_fixes(F.concat("said", F.lit(" "), "text", F.lit("  "), "said")).alias("fixed"))


KEPT_SQL = " AND ".join(f"(NOT contains(lower(a), '{t.lower()}') OR contains(lower(b), '{t.lower()}'))" for t in curation.VOICE_TERMS)


@query(f"SELECT conv_id, turn, {KEPT_SQL} AS kept FROM (SELECT conv_id, turn, text || ' ' || {SPOKEN_SQL} AS a, CASE WHEN turn % 2 = 0 THEN upper({SPOKEN_SQL}) || text ELSE text || ' usb wi-fi' END AS b FROM conversations WHERE text IS NOT NULL)")
def protected_terms(s, d):
    t = _spoken(s, d).withColumns({"a": F.concat("text", F.lit(" "), "said"), "b": F.when(F.col("turn") % 2 == 0, F.concat(F.upper("said"), "text")).otherwise(F.concat("text", F.lit(" usb wi-fi")))})
    return t.select("conv_id", "turn", curation.preserves_terms(F.col("a"), F.col("b")).alias("kept"))


#: Replies of a model about an image, good and bad ones, around the texts of conversations (as JSON strings).
REPLIES = ("so {{\"relevant\": true, \"error_text\": {t}}} end", "{{\"relevant\": \"true\", \"error_text\": {t}}}", "{{\"relevant\": true, \"error_text\": 5, \"t\": {t}}}", "{{\"relevant\": true, \"error_text\": {t}", "{{\"relevant\": false, \"error_text\": {t}}}", "x {t}")


def _pieces(reply: str) -> list[str]:
    return reply.replace("{{", "{").replace("}}", "}").split("{t}")


REPLY_SQL = "CASE (turn + conv_id) % 6 " + " ".join(f"WHEN {i} THEN '{_pieces(r)[0]}' || to_json(left(text, 40 * ((turn + conv_id) % 16 + 1))) || '{_pieces(r)[1]}'" for i, r in enumerate(REPLIES)) + " END"


@query(
    f"WITH r AS (SELECT conv_id, turn, regexp_extract({REPLY_SQL}, '\\{{.*\\}}', 0, 's') AS j FROM conversations WHERE text IS NOT NULL),"
    " f AS (SELECT conv_id, turn, CASE WHEN json_valid(j) AND j <> '' THEN json_extract(j, '$.relevant') END AS rel, CASE WHEN json_valid(j) AND j <> '' THEN json_extract(j, '$.error_text') END AS err FROM r),"
    " g AS (SELECT conv_id, turn, coalesce(json_type(rel) = 'BOOLEAN' AND rel::VARCHAR = 'true', false) AS rel, CASE WHEN json_type(err) = 'VARCHAR' THEN trim(regexp_replace(json_extract_string(err, '$'), '\\s+', ' ', 'g')) END AS t FROM f)"
    " SELECT conv_id, turn, coalesce(rel AND length(t) BETWEEN 1 AND 500, false) AS relevant, CASE WHEN coalesce(rel AND length(t) BETWEEN 1 AND 500, false) THEN t ELSE '' END AS error_text FROM g"
)
def json_fail_closed(s, d):
    k = F.col("turn") + F.col("conv_id")
    short = F.expr("left(text, cast(40 * ((turn + conv_id) % 16 + 1) as int))")
    t = read(s, d, "conversations").filter("text is not null").withColumn("short", short)
    quoted = F.expr("substring(to_json(struct(short as t)), 6, length(to_json(struct(short as t))) - 6)")
    forms = [F.concat(F.lit(_pieces(r)[0]), quoted, F.lit(_pieces(r)[1])) for r in REPLIES]
    reply = F.element_at(F.array(*forms), (k % 6 + 1).cast("int"))
    return t.select("conv_id", "turn", curation.parse_verdict(reply).alias("v")).select("conv_id", "turn", "v.*")


SPLIT = r"(^|[^0-9])([0-9]{1,2}[./_-][0-9]{1,2}[./_-])20[./_-]([0-9]{2})($|[^0-9])"


@query(
    "SELECT l_orderkey, l_linenumber, count(*) AS n, regexp_replace(t, '" + SPLIT + r"', '\1\220\3\4', 'g') AS t FROM (SELECT l_orderkey, l_linenumber, 'ngay ' || strftime(l_shipdate, '%d.%m.20.%y') || ' den  ' || strftime(l_shipdate, '%d-%m-20_%y')"
    " || ', so ' || (l_partkey % 1000) || '.' || l_linenumber || '.20.' || (l_suppkey % 150) || '.' AS t FROM lineitem) GROUP BY ALL"
)
def ocr_date_repair(s, d):
    form = lambda pattern: F.date_format("l_shipdate", pattern)
    t = F.concat(F.lit("ngay "), form("dd.MM.'20'.yy"), F.lit(" den  "), form("dd-MM-'20'_yy"), F.lit(", so "), (F.col("l_partkey") % 1000).cast("string"), F.lit("."), F.col("l_linenumber").cast("string"), F.lit(".20."), (F.col("l_suppkey") % 150).cast("string"), F.lit("."))
    rows = read(s, d, "lineitem").select("l_orderkey", "l_linenumber", curation.repair_dates(t).alias("t"))
    return rows.groupBy("l_orderkey", "l_linenumber", "t").agg(F.count("*").alias("n"))


ASKS = ("Hướng dẫn đăng nhập ", "bước 2 làm sao ", "HOW TO ", "tại sao ", "Các bước  ")
STEPPED = ("1. a\nBước 2: b\n", "x\n  bước 1) ", "\n3: mot\n4. hai ", "khong ", "1. a\n 1) b")


@query(
    f"WITH q AS (SELECT conv_id, turn, {FOLD('(' + str(list(ASKS)) + ')[turn % 5 + 1] || text')} AS q, {FOLD('(' + str([x.replace(chr(10), '~') for x in STEPPED]) + ')[conv_id % 5 + 1] || text')} AS a0 FROM conversations WHERE text IS NOT NULL),"
    " p AS (SELECT conv_id, turn, trim(regexp_replace(q, '\\s+', ' ', 'g')) AS q, replace(a0, '~', chr(10)) AS a FROM q)"
    " SELECT conv_id, turn, NOT regexp_matches(q, '\\b(?:buoc|step)\\s*\\d+\\b') AND regexp_matches(q, 'huong dan|cac buoc|cach lam|lam sao|how to')"
    " AND len(list_distinct(regexp_extract_all(a, '(?m)(?:^|\\n)\\s*(?:buoc\\s*)?(\\d+)\\s*[.):]', 1))) >= 2 AS overview FROM p"
)
def procedural_overview(s, d):
    pick = lambda values, c: F.element_at(F.array(*map(F.lit, values)), (F.col(c) % 5 + 1).cast("int"))
    t = read(s, d, "conversations").filter("text is not null").withColumns({"q": F.concat(pick(ASKS, "turn"), "text"), "a": F.concat(pick(STEPPED, "conv_id"), "text")})
    return t.select("conv_id", "turn", curation.procedural_overview(text.fold_ws("q"), text.fold_raw("a")).alias("overview"))


@query(
    f"SELECT DISTINCT source FROM documents WHERE contains({FOLD('source')}, 'src1')"
)
def document_search(s, d):
    return read(s, d, "documents").select("source").distinct().filter(F.contains(text.fold_ws("source"), F.lit("src1")))
