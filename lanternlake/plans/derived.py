"""Named documents, manifests, answers and candidates that queries derive from the tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import retrieval, temporal as X
from ..sources.tables import read
from ..sources.work import work_table

#: Names of documents: number, source and first words of the text, an audience and, for most, a day; all from the row.
KINDS = ("", "GV", "SV", "", "speaking")


def named(s, d):
    """(doc_id, source, content, day) of all documents, under names such as a library of guides has."""
    first = F.coalesce(F.nullif(F.lower(F.regexp_extract("text", "[A-Za-z]{3,}", 0)), F.lit("")), F.lit("none"))
    second = F.lower(F.regexp_extract("text", "[A-Za-z]{3,}[^A-Za-z]+([A-Za-z]{2,})", 1))
    word = F.concat(first, F.lit(" "), F.coalesce(second, F.lit("")))
    day = F.date_add(F.lit("2015-01-01").cast("date"), (F.col("doc_id") % 3650).cast("int"))
    kind = F.element_at(F.array(*map(F.lit, KINDS)), (F.col("doc_id") % 5 + 1).cast("int"))
    name = F.concat(
        F.col("doc_id").cast("string"), F.lit(". HD "), "source", F.lit(" "), word, F.lit(" "), kind, F.lit(" "),
        F.when(F.col("doc_id") % 11 != 0, F.date_format(day, "dd.MM.yyyy")).otherwise("final"), F.lit(".pdf"),
    )
    return read(s, d, "documents").select("doc_id", name.alias("source"), F.col("text").alias("content"), F.when(F.col("doc_id") % 11 != 0, day.cast("string")).alias("day"))


NAMED_SQL = """named AS (SELECT doc_id, doc_id || '. HD ' || source || ' ' || coalesce(nullif(lower(regexp_extract(text, '[A-Za-z]{3,}', 0)), ''), 'none') || ' '
  || coalesce(lower(regexp_extract(text, '[A-Za-z]{3,}[^A-Za-z]+([A-Za-z]{2,})', 1)), '') || ' '
  || (['', 'GV', 'SV', '', 'speaking'])[doc_id % 5 + 1] || ' ' || CASE WHEN doc_id % 11 <> 0 THEN strftime(DATE '2015-01-01' + CAST(doc_id % 3650 AS INT), '%d.%m.%Y') ELSE 'final' END || '.pdf' AS source,
  text AS content, CASE WHEN doc_id % 11 <> 0 THEN strftime(DATE '2015-01-01' + CAST(doc_id % 3650 AS INT), '%Y-%m-%d') END AS day FROM documents)"""

MEMBER = "family_id, source, day, temporal_status"


def generated(s, d):
    """Manifest rows of the dated documents, a family for each source table value and audience."""
    family = F.concat(F.lit("f"), (F.col("doc_id") % 60).cast("string"))
    return named(s, d).filter("day is not null").select("source", family.alias("family_id"), "day", F.lit("candidate").alias("temporal_status"))


def manual(s, d):
    """Corrections by hand: another day, no family or status alone, and documents that nothing else knows."""
    rows = named(s, d).filter("doc_id % 7 = 0")
    family = F.when(F.col("doc_id") % 14 != 0, F.concat(F.lit("f"), (F.col("doc_id") % 30).cast("string")))
    name = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("manual "), "source")).otherwise(F.col("source"))
    day = F.when(F.col("doc_id") % 2 == 0, F.date_add(F.col("day").cast("date"), 40).cast("string"))
    return rows.select(name.alias("source"), family.alias("family_id"), day.alias("day"), F.lit("verified").alias("temporal_status"))


MANIFEST_SQL = """g AS (SELECT source, 'f' || doc_id % 60 AS family_id, day, 'candidate' AS temporal_status FROM named WHERE day IS NOT NULL),
m AS (SELECT CASE WHEN doc_id % 3 = 0 THEN 'manual ' || source ELSE source END AS source, CASE WHEN doc_id % 14 <> 0 THEN 'f' || doc_id % 30 END AS family_id,
  CASE WHEN doc_id % 2 = 0 THEN strftime(CAST(day AS DATE) + 40, '%Y-%m-%d') END AS day, 'verified' AS temporal_status FROM named WHERE doc_id % 7 = 0),
merged AS (SELECT coalesce(m.source, g.source) AS source, coalesce(m.family_id, g.family_id) AS family_id, coalesce(m.day, g.day) AS day,
  coalesce(m.temporal_status, g.temporal_status) AS temporal_status FROM g FULL JOIN m ON g.source = m.source),
ranked AS (SELECT *, dense_rank() OVER (PARTITION BY family_id ORDER BY day NULLS FIRST) AS version_rank FROM merged)"""


def merged(s, d):
    return X.merge_manifests(generated(s, d), manual(s, d))


def pages(s, d):
    """(source, page, text) of all documents."""
    return named(s, d).select("source", (F.col("doc_id") % 4 + 1).cast("int").alias("page"), F.col("content").alias("text"))


def page_overrides(s, d):
    rows = named(s, d).filter("doc_id % 6 = 0")
    some = lambda n, value: F.when(F.col("doc_id") % n == 0, value)
    return rows.select(
        "source", (F.col("doc_id") % 2 + F.col("doc_id") % 4 + 1).cast("int").alias("page"), some(12, F.concat(F.lit("f"), (F.col("doc_id") % 60).cast("string"))).alias("family_id"),
        some(18, F.lit("2030-01-01")).alias("day"), some(24, F.lit(99)).alias("version_rank"), F.lit("verified").alias("temporal_status"),
        some(30, F.concat(F.lit("seen "), F.col("doc_id").cast("string"))).alias("verified_visual_fact"),
    )


ENRICHED_SQL = f"""{NAMED_SQL}, {MANIFEST_SQL}, c AS (SELECT source, CAST(doc_id % 4 + 1 AS INT) AS page, content AS text FROM named),
o AS (SELECT source, CAST(doc_id % 2 + doc_id % 4 + 1 AS INT) AS page, CASE WHEN doc_id % 12 = 0 THEN 'f' || doc_id % 60 END AS family_id, CASE WHEN doc_id % 18 = 0 THEN '2030-01-01' END AS day,
  CASE WHEN doc_id % 24 = 0 THEN 99 END AS version_rank, 'verified' AS temporal_status, CASE WHEN doc_id % 30 = 0 THEN 'seen ' || doc_id END AS fact FROM named WHERE doc_id % 6 = 0),
enriched AS (SELECT c.source, c.page, concat_ws(chr(10), text, fact) AS text, coalesce(o.family_id, r.family_id) AS family_id, coalesce(o.day, r.day) AS day,
  coalesce(o.version_rank, r.version_rank) AS version_rank, coalesce(o.temporal_status, r.temporal_status) AS temporal_status
  FROM c LEFT JOIN ranked r USING (source) LEFT JOIN o ON o.source = c.source AND o.page = c.page)"""


def enriched(s, d):
    return X.enrich(pages(s, d), merged(s, d), page_overrides(s, d)).select("source", "page", "text", "family_id", "day", "version_rank", "temporal_status")


def editions(s, d):
    """(doc_id, family_id, day, version_rank): documents of a source and language by tens are versions of one text."""
    rows = read(s, d, "documents").select(
        "doc_id", F.concat_ws("-", "source", "lang", (F.col("doc_id") % 3).cast("string")).alias("family_id"),
        F.date_add(F.lit("2015-01-01").cast("date"), (F.col("doc_id") % 3650).cast("int")).cast("string").alias("day"),
    )
    return X.version_ranks(rows)


def questions(s, d):
    """Benchmark items as questions; every fourth asks for the latest."""
    text = F.when(F.col("item_id") % 4 == 0, F.concat("text", F.lit(" phiên bản mới nhất"))).otherwise(F.col("text"))
    return read(s, d, "benchmark").select(F.col("item_id").alias("query_id"), text.alias("text"))


def candidates(s, d):
    """Lexical hits of all questions as candidates of their families, with the texts of the documents."""
    hits = retrieval.bm25_top(questions(s, d), read(s, d, "documents").select(F.col("doc_id").alias("idx"), "text"))
    docs = read(s, d, "documents").select(F.col("doc_id").alias("cand_id"), "source", F.col("text").alias("content"))
    found = hits.withColumnRenamed("idx", "cand_id").join(docs, "cand_id").join(editions(s, d).withColumnRenamed("doc_id", "cand_id"), "cand_id")
    heading = F.substring(F.element_at(F.split("content", "\n", 2), 1), 1, 80)
    found = found.join(questions(s, d).withColumnRenamed("text", "query"), "query_id").select(
        "query_id", "query", "family_id", "version_rank", "cand_id", "source", heading.alias("heading"), heading.alias("section_path"), "content",
        (F.col("bm25_score") / 100).alias("score"), F.col("bm25_rank").alias("position"),
    )
    # Written, as features read the few candidates several times, and each time all texts otherwise.
    return work_table(found, "candidates")


def newest(s, d, families):
    """All documents of the newest version of the families."""
    last = editions(s, d).join(families, "family_id").filter("version_rank = newest_rank").select("family_id", "version_rank", F.col("doc_id").alias("cand_id"))
    docs = read(s, d, "documents").select(F.col("doc_id").alias("cand_id"), "source", F.col("text").alias("content"))
    heading = F.substring(F.element_at(F.split("content", "\n", 2), 1), 1, 80)
    return last.join(docs, "cand_id").select("family_id", "version_rank", "cand_id", "source", heading.alias("heading"), heading.alias("section_path"), "content")


def catalogue(s, d):
    """Families with two or more versions."""
    return X.catalog(editions(s, d).withColumn("temporal_status", F.lit("verified")))


def dated(s, d):
    """(id, t): dates in several forms, some of days that do not exist, and addresses, for every order position."""
    form = lambda pattern: F.date_format("l_shipdate", pattern)
    number = lambda c: F.col(c).cast("string")
    odd = F.concat(form("dd"), F.lit("_"), F.lpad((F.col("l_linenumber") * 2 - 1).cast("string"), 2, "0"), F.lit("_"), form("yyyy"))
    text = F.concat(
        F.lit("giao "), form("dd.MM.yyyy"), F.lit("  kho "), form("d-M-yy"), F.lit(" ip "), (F.col("l_partkey") % 200).cast("string"), F.lit("."), (F.col("l_suppkey") % 100).cast("string"),
        F.lit("."), number("l_linenumber"), F.lit("."), (F.col("l_partkey") % 300).cast("string"), F.lit(" x"), number("l_orderkey"), F.lit(" "), odd,
    )
    return read(s, d, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), text.alias("t"))


DATED_SQL = """dated AS (SELECT l_orderkey * 10 + l_linenumber AS id, 'giao ' || strftime(l_shipdate, '%d.%m.%Y') || '  kho ' || day(l_shipdate) || '-' || month(l_shipdate) || '-' || strftime(l_shipdate, '%y')
  || ' ip ' || l_partkey % 200 || '.' || l_suppkey % 100 || '.' || l_linenumber || '.' || l_partkey % 300 || ' x' || l_orderkey || ' '
  || strftime(l_shipdate, '%d') || '_' || lpad(CAST(l_linenumber * 2 - 1 AS VARCHAR), 2, '0') || '_' || strftime(l_shipdate, '%Y') AS t FROM lineitem)"""


def release_pages(s, d):
    """(id, content): notices of releases, changes and exam days, one for every order position."""
    day, product = F.date_format("l_shipdate", "dd.MM.yyyy"), F.concat(F.lit("Soft"), F.col("l_suppkey").cast("string"))
    forms = [
        F.concat(F.lit("Phiên bản "), product, F.lit("Client.zip ngày "), day), F.concat(F.lit("không dấu hiệu "), day), F.concat(F.lit("update "), product, F.lit("Installer "), day),
        F.concat(F.lit("lịch thi, ngày thi "), day, F.lit(" version "), product), F.concat(F.lit("Tải phần mềm: "), product, F.lit("Agent "), day, F.lit(" và "), product, F.lit("Agent 03.04.2024 update")),
    ]
    return read(s, d, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.element_at(F.array(*forms), (F.col("l_linenumber") % 5 + 1)).alias("content"))
