"""Version queries over documents that are named and dated by their rows, with SQL where it can express them."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text
from ..operators import temporal as X
from ..sources.tables import read
from . import derived as D
from .retrieval_queries import FOLD

QUERIES, ORACLES = {}, {}


def query(sql=None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


DATE_SQL = r"(^|[^0-9])((0?[1-9]|[12][0-9]|3[01])[./_-](0?[1-9]|1[0-2])[./_-](20[0-9]{2}|[0-9]{2}))($|[^0-9])"


@query(
    f"WITH {D.DATED_SQL}, raws AS (SELECT id, unnest(regexp_extract_all(t, '{DATE_SQL}', 2)) AS raw FROM dated),"
    " parts AS (SELECT id, raw, string_split_regex(raw, '[./_-]') AS p FROM raws),"
    " days AS (SELECT id, raw, try_cast((CASE WHEN length(p[3]) = 2 THEN '20' || p[3] ELSE p[3] END) || '-' || lpad(p[2], 2, '0') || '-' || lpad(p[1], 2, '0') AS DATE) AS day FROM parts)"
    " SELECT id, strftime(day, '%Y-%m-%d') AS day, raw FROM days WHERE day IS NOT NULL"
)
def extract_dates(s, d):
    found = D.dated(s, d).select("id", F.explode(X.extract_dates("t")).alias("x"))
    return found.select("id", "x.day", "x.raw")


def words_sql(words) -> str:
    return "[" + ", ".join(f"'{w}'" for w in sorted(words)) + "]"


DISTINCT = lambda c: f"list_filter({c}, lambda x, i: list_position({c}, x) = i)"
SPELLED = " ".join(f"WHEN '{k}' THEN {words_sql([]) if not v else '[' + ', '.join(repr(x) for x in v) + ']'}" for k, v in X.ABBREVIATIONS.items())
PROFILES = f"""{D.NAMED_SQL},
stems AS (SELECT source, content, regexp_replace(regexp_replace(regexp_replace({FOLD("source")}, '[.][^.]+$', ''), '{DATE_SQL}', '\\1 \\6', 'g'), '^ *[0-9]+ *[.)_-]+ *', ' ') AS n FROM named),
worded AS (SELECT source, content, flatten(list_transform(list_filter(regexp_extract_all(n, '[a-z][a-z0-9]*'), lambda w: NOT list_contains({words_sql(X.TITLE_NOISE)}, w)),
  lambda w: CASE w {SPELLED} ELSE [w] END)) AS words FROM stems),
topics AS (SELECT source, content, words, list_filter(words, lambda w: NOT list_contains({words_sql(X.AUDIENCE | X.TITLE_CONNECTORS)}, w)) AS topic,
  {FOLD("left(coalesce(content, ''), 12000)")} AS sample, {FOLD("left(coalesce(content, ''), 20000)")} AS body FROM worded),
counted AS (SELECT *, len(regexp_extract_all(sample, '{X.GUARDS}')) AS guards, len(regexp_extract_all(sample, '{X.LEARNERS}')) AS learners, array_to_string(words, ' ') AS joined FROM topics),
profiles AS (SELECT source, coalesce(nullif(array_to_string({DISTINCT("topic")}, ' '), ''), 'document') AS canonical, array_to_string(list_sort(list_distinct(topic)), ' ') AS title_tokens,
  CASE WHEN list_contains(words, 'speaking') THEN 'speaking' WHEN regexp_matches(joined, '{X.TITLE_GUARDS}') THEN 'invigilator' WHEN regexp_matches(joined, '{X.TITLE_LEARNERS}') THEN 'student'
    WHEN len(regexp_extract_all(sample, '\\bspeaking\\b')) >= 2 THEN 'speaking' WHEN guards >= 2 AND guards >= 0.35 * learners THEN 'invigilator' WHEN learners >= 3 AND guards = 0 THEN 'student' ELSE 'general' END AS subtype,
  array_to_string(list_sort(list_distinct(list_filter(regexp_extract_all(body, '[a-z][a-z0-9]+'), lambda w: NOT list_contains({words_sql(X.CONTENT_STOPWORDS)}, w)))), ' ') AS terms FROM counted)"""


@query(f"WITH {PROFILES} SELECT source, canonical, title_tokens, subtype, sha256(terms) AS terms FROM profiles")
def title_profile(s, d):
    p = X.title_profiles(D.named(s, d))
    return p.select("source", "canonical", F.array_join("title_tokens", " ").alias("title_tokens"), "subtype", F.sha2(F.array_join("terms", " "), 256).alias("terms"))


SLUG = "left(regexp_replace(regexp_replace(canonical, '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g'), 42)"


@query(f"WITH {PROFILES} SELECT source, 'auto_' || coalesce(nullif({SLUG}, ''), 'document') || '_' || subtype || '_' || left(sha1(canonical || '|' || subtype), 8) AS family_id FROM profiles")
def family_id(s, d):
    """The family that a document would found alone."""
    return X.title_profiles(D.named(s, d)).select("source", X.family_id(F.col("canonical"), F.col("subtype")).alias("family_id"))


@query()
def family_links(s, d):
    links = X.class_links(X.title_classes(X.whole_profiles(D.named(s, d))))
    return links.select("left", "right", F.round("least", 6).alias("least"), "linked", F.round("total", 4).alias("total"))


@query()
def families(s, d):
    return X.families(X.whole_profiles(D.named(s, d)))


@query()
def family_label(s, d):
    found = X.families(X.whole_profiles(D.named(s, d)))
    return found.groupBy("family_id", "label", "subtype").agg(F.count("*").alias("documents"))


@query()
def family_confidence(s, d):
    found = X.families(X.whole_profiles(D.named(s, d)))
    return found.groupBy("family_id").agg(F.max("confidence").alias("confidence"), F.max("size").alias("largest"))


@query()
def temporal_discover(s, d):
    notices = D.release_pages(s, d).select(F.concat(F.lit("notice "), (F.col("id") % 97).cast("string"), F.lit(".pdf")).alias("source"), F.floor(F.col("id") / 97).cast("int").alias("page"), "content")
    return X.discover(D.named(s, d), notices)


@query()
def release_dates(s, d):
    return X.release_dates(D.release_pages(s, d)).drop("content")


@query(f"WITH {D.NAMED_SQL}, {D.MANIFEST_SQL} SELECT source, family_id, day, dense_rank() OVER (PARTITION BY family_id ORDER BY day) AS version_rank FROM g")
def version_rank(s, d):
    return X.version_ranks(D.generated(s, d).drop("temporal_status"))


@query(f"WITH {D.NAMED_SQL}, {D.MANIFEST_SQL} SELECT * FROM ranked")
def manifest_merge(s, d):
    return D.merged(s, d)


ODD = "odd AS (SELECT CASE WHEN doc_id % 13 = 0 THEN '  ' WHEN doc_id % 17 <> 0 THEN source END AS source, CASE WHEN doc_id % 3 > 0 THEN CAST(doc_id % 40 - 1 AS INT) END AS page, CASE WHEN doc_id % 19 = 0 THEN '' ELSE lang END AS family_id, CAST(doc_id % 5 AS INT) AS version_rank FROM documents)"


@query(
    f"WITH {ODD} SELECT source, page, 'no source' AS problem FROM odd WHERE trim(coalesce(source, '')) = ''"
    " UNION ALL SELECT source, page, 'no family' FROM odd WHERE trim(coalesce(family_id, '')) = '' UNION ALL SELECT source, page, 'bad rank' FROM odd WHERE version_rank < 1"
    " UNION ALL SELECT source, page, 'bad page' FROM odd WHERE page < 1 UNION ALL SELECT source, page, 'twice' FROM odd GROUP BY source, page HAVING count(*) > 1"
)
def manifest_validate(s, d):
    n = F.col("doc_id")
    odd = read(s, d, "documents").select(
        F.when(n % 13 == 0, "  ").when(n % 17 != 0, F.col("source")).alias("source"), F.when(n % 3 > 0, (n % 40 - 1).cast("int")).alias("page"),
        F.when(n % 19 == 0, "").otherwise(F.col("lang")).alias("family_id"), (n % 5).cast("int").alias("version_rank"),
    )
    return X.manifest_errors(odd)


@query(f"WITH {D.ENRICHED_SQL} SELECT * FROM enriched")
def temporal_enrich(s, d):
    return D.enriched(s, d)


CATALOG = """SELECT family_id, max(version_rank) AS newest_rank, count(DISTINCT version_rank) AS n_ranks FROM {t} WHERE family_id IS NOT NULL
GROUP BY family_id HAVING bool_and(coalesce(temporal_status = 'verified' AND version_rank IS NOT NULL, false)) AND count(DISTINCT version_rank) >= 2"""


@query(f"WITH {D.ENRICHED_SQL}, sure AS (SELECT * REPLACE (CASE WHEN CAST(substr(family_id, 2) AS INT) % 2 = 0 THEN 'verified' ELSE temporal_status END AS temporal_status) FROM enriched) {CATALOG.format(t='sure')}")
def temporal_catalog(s, d):
    """Families of enriched pages, after those with even numbers were verified by hand."""
    even = F.expr("cast(substring(family_id, 2) as int) % 2 = 0")
    return X.catalog(D.enriched(s, d).withColumn("temporal_status", F.when(even, "verified").otherwise(F.col("temporal_status"))))


@query()
def claim_features(s, d):
    out = X.claim_features(D.candidates(s, d).withColumn("relevance", F.col("score")))
    return out.select("query_id", "family_id", "cand_id", *(F.round(c, 6).alias(c) for c in ("coverage", "bigram", "bm25_norm", "ident", "relevance", "differential")))


@query()
def temporal_resolve(s, d):
    """Injection of missing newest versions, features, and the choice within each family, for all questions."""
    families_ = D.catalogue(s, d)
    out = X.resolve(D.candidates(s, d), families_, D.newest(s, d, families_))
    return out.select("query_id", "family_id", "cand_id", "version_rank", F.round("score", 6).alias("score"), "action", "historical", "rank")


SQUEEZED = lambda c: f"trim(regexp_replace({FOLD(c)}, '\\s+', ' ', 'g'))"
ASKED = "CASE turn % 5 WHEN 0 THEN text || ' bản MỚI   nhất?' WHEN 1 THEN 'Current' || chr(10) || 'Version ' || text ELSE text END"


@query(f"SELECT conv_id, turn, {' OR '.join(f'contains({SQUEEZED(ASKED)}, {m!r})' for m in X.LATEST_MARKERS)} AS latest FROM conversations WHERE text IS NOT NULL")
def latest_intent(s, d):
    asked = F.when(F.col("turn") % 5 == 0, F.concat("text", F.lit(" bản MỚI   nhất?"))).when(F.col("turn") % 5 == 1, F.concat(F.lit("Current\nVersion "), "text")).otherwise(F.col("text"))
    return read(s, d, "conversations").filter("text is not null").select("conv_id", "turn", X.asks_latest(text.fold_ws(asked)).alias("latest"))
