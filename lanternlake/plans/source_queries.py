"""Queries through files, stores and commits: what was written from the tables is read again, with SQL over the tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import curation, text
from ..operators import evidence, lexical, reports as R, retrieval
from ..sources import files, journal, store, tables as T
from ..sources.tables import CHAT_SQL, DOCUMENTS_SQL, TOPICS_SQL, USERS_SQL, read, with_sql
from ..sources.work import shared_folder
from . import derived as D
from .report_queries import SCOPED, chats
from .retrieval_queries import FOLD, POST, SPARSE, corpus, questions

QUERIES, ORACLES = {}, {}


def query(sql=None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


def folder(s, name: str) -> str:
    return f"{shared_folder(s)}/{name}-{uuid.uuid4().hex}"


@query("SELECT doc_id, regexp_replace(replace(replace(text, chr(160), ' '), chr(10) || chr(10), chr(10)), '^\\s+|\\s+$', '', 'g') AS text FROM documents")
def page_text(s, d):
    return read(s, d, "documents").select("doc_id", text.page_text(F.col("text")).alias("text"))


SCANS = ["", "phiên bản mới", "version 01.02.2024", "Update", "no mark", "tải download 1/2/24 x"]


@query(
    f"SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN t = '' THEN true ELSE regexp_matches(lower(t), 'phiên bản|phien ban|version|release|cập nhật|cap nhat|update|download') AND l_discount * 4 >= 0.25"
    " AND NOT regexp_matches(t, '(^|[^0-9])[0-9]{1,2}[./_-][0-9]{1,2}[./_-](?:20)?[0-9]{2}($|[^0-9])') END AND l_tax > 0.01 AS wanted"
    f" FROM (SELECT *, ({SCANS})[l_partkey % {len(SCANS)} + 1] AS t FROM lineitem)"
)
def pages_to_read(s, d):
    """Whether scanned pages, one for each order position, are to be read from their images."""
    t = F.element_at(F.array(*map(F.lit, SCANS)), (F.col("l_partkey") % len(SCANS) + 1).cast("int"))
    return read(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", files.needs_reading(t, F.col("l_discount") * 4, F.col("l_tax") > 0.01).alias("wanted"))


@query(
    "SELECT l_orderkey AS page, round(least(sum(greatest(l_quantity - 10, 0) * greatest(l_linenumber - 1, 0)) / max(l_orderkey % 900), 1.0), 9) AS share FROM lineitem GROUP BY 1 HAVING max(l_orderkey % 900) > 0"
    " UNION ALL SELECT DISTINCT l_orderkey, 0.0 FROM lineitem WHERE l_orderkey % 900 = 0"
)
def image_share(s, d):
    """The share of a page that its images cover: an order is a page, its positions are images, some without any extent."""
    boxes = F.collect_list(F.struct((F.col("l_quantity") - 10).alias("w"), (F.col("l_linenumber") - 1).cast("double").alias("h")))
    pages = read(s, d, "lineitem").groupBy("l_orderkey").agg(boxes.alias("b"))
    return pages.select(F.col("l_orderkey").alias("page"), F.round(files.image_ratio(F.col("b"), (F.col("l_orderkey") % 900).cast("double")), 9).alias("share"))


@query(
    "WITH f AS (SELECT l_orderkey AS page_id, 'line ' || (l_partkey % 5) AS line, min(l_linenumber) AS position FROM lineitem WHERE l_discount * 10 >= 0.65 GROUP BY 1, 2)"
    " SELECT page_id, string_agg(line, chr(10) ORDER BY position, line) AS text FROM f GROUP BY 1"
)
def sure_lines(s, d):
    """Lines of scanned pages that were read with enough confidence, each once."""
    rows = read(s, d, "lineitem").select(F.col("l_orderkey").alias("page_id"), F.col("l_linenumber").alias("position"), F.concat(F.lit("line "), (F.col("l_partkey") % 5).cast("string")).alias("line"), (F.col("l_discount") * 10).alias("confidence"))
    return files.sure_lines(rows)


NAMES = ["{n}.pdf", "{n}.PDF", "a/{n}.pdf", "{n}.txt", "..", ".pdf", "{n}\n.pdf", " {n}.pdf ", "\\{n}.pdf"]
NAMES_SQL = "CASE p_partkey % 9 " + " ".join(f"WHEN {i} THEN " + ("'" + x.replace("{n}", "' || p_name || '").replace("\n", "' || chr(10) || '") + "'") for i, x in enumerate(NAMES)) + " END"


@query(
    f"SELECT p_partkey, NOT regexp_matches(n, '[\\x00-\\x1f\\x7f/\\\\]') AND n NOT IN ('.', '..') AND lower(n) LIKE '%.pdf' AND length(trim(n, ' ')) > 4 AS valid FROM (SELECT p_partkey, {NAMES_SQL} AS n FROM part)"
)
def valid_names(s, d):
    forms = [F.concat(*(F.lit(x) if i == 0 else F.concat("p_name", F.lit(x)) for i, x in enumerate(n.split("{n}")))) for n in NAMES]
    name = F.element_at(F.array(*forms), (F.col("p_partkey") % 9 + 1).cast("int"))
    return read(s, d, "part").select("p_partkey", files.valid_name(name).alias("valid"))


@query("SELECT conv_id, turn, role, text FROM conversations")
def json_lists(s, d):
    """All turns through files that hold one JSON list each, for every role and tenth of the conversations; a broken file has no rows."""
    path = folder(s, "lists")
    rows = read(s, d, "conversations")
    lists = rows.groupBy("role", (F.col("conv_id") % 10).alias("k")).agg(F.to_json(F.collect_list(F.struct("conv_id", "turn", "role", "text"))).alias("value"))
    lists.select("value").union(s.range(1).select(F.lit('[{"conv_id": 1'))).write.option("maxRecordsPerFile", 1).text(path)
    return files.json_rows(s, path, "conv_id long, turn long, role string, text string").filter("conv_id is not null")


@query(f"WITH {D.NAMED_SQL}, {D.MANIFEST_SQL} SELECT source, family_id, day, version_rank, temporal_status FROM ranked")
def manifest_json(s, d):
    """A merged manifest through its JSON file, in the order of names without case."""
    path = folder(s, "manifest")
    store.write_manifest(D.merged(s, d), path)
    return s.read.schema("source string, family_id string, day string, version_rank int, temporal_status string").json(path)


@query(f"WITH {POST}, {SPARSE} SELECT query_id, idx, bm25_score, bm25_rank FROM sparse")
def stored_topk(s, d):
    """Search in a stored index, after another version was installed and taken back."""
    root = folder(s, "index")
    first = store.install(root, lexical.build(corpus(s, d)))
    store.install(root, lexical.build(corpus(s, d).limit(0)))
    store.point(root, first)
    index = {name: store.load(s, root, name) for name in ("blocks", "words", "totals")}
    return retrieval.bm25_top(questions(s, d), None, index=index)


@query(
    f"{with_sql(CHAT_SQL, USERS_SQL, TOPICS_SQL)}, c AS ({SCOPED}) SELECT 'topics' AS sheet, coalesce(name, 'General Guidance') AS label, CAST(count(*) AS VARCHAR) AS value FROM c LEFT JOIN topics USING (topic_id) GROUP BY name"
    " UNION ALL SELECT 'users', CAST(user_id AS VARCHAR), CAST(n AS VARCHAR) FROM (SELECT user_id, count(*) AS n FROM c GROUP BY 1 ORDER BY n DESC, user_id LIMIT 10)"
)
def report_export(s, d):
    """Two sheets of a report through their CSV files: questions by topic and the ten users with most."""
    path, live = folder(s, "report"), chats(s, d)
    topics = R.by_topic(live, T.topics(s)).select(F.col("topic").alias("label"), F.col("questions").alias("value"))
    users = R.top_users(live, T.users(s, d), 10).select(F.col("user_id").alias("label"), F.col("questions").alias("value"))
    store.export({"topics": topics, "users": users}, path)
    sheet = lambda name: s.read.option("header", True).csv(f"{path}/{name}").select(F.lit(name).alias("sheet"), "label", "value")
    return sheet("topics").union(sheet("users"))


@query(f"{with_sql(DOCUMENTS_SQL)} SELECT id, file_size FROM stored ORDER BY file_size DESC, id LIMIT 10")
def largest_documents(s, d):
    return R.sort_documents(T.catalogue_documents(s, d).withColumn("updated_at", F.col("id")), "size_desc").limit(10).select("id", "file_size")


@query(
    "WITH n AS (SELECT conv_id, turn, text, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS seen FROM conversations)"
    " SELECT conv_id, turn, concat_ws(chr(10), nullif(trim(text, ' '), ''), CASE WHEN turn % 3 <> 1 THEN nullif(trim(seen, ' '), '') END) AS question FROM n"
)
def image_questions(s, d):
    """Questions with what an image adds to them: the next turn stands for its text, and a third of the images is not valid."""
    from pyspark.sql.window import Window

    seen = F.lead("text").over(Window.partitionBy("conv_id").orderBy("turn"))
    rows = read(s, d, "conversations").select("conv_id", "turn", "text", seen.alias("seen"))
    return rows.select("conv_id", "turn", curation.question_with_image(F.col("text"), F.col("seen"), F.col("turn") % 3 != 1).alias("question"))


@query(f"SELECT doc_id, sha256(trim(regexp_replace({FOLD('text')}, '[^\\p{{L}}\\p{{N}}_]+', ' ', 'g'), ' ')) AS key FROM documents")
def content_keys(s, d):
    return read(s, d, "documents").select("doc_id", F.sha2(evidence.content_key(F.col("text")), 256).alias("key"))


@query("SELECT doc_id, sha256(lower(strip_accents(text))) AS folded FROM documents")
def search_folding(s, d):
    """Texts as the search box folds them, which keeps ß."""
    return read(s, d, "documents").select("doc_id", F.sha2(text.fold_ui("text"), 256).alias("folded"))


@query("SELECT 'nations' AS store, CAST(n_nationkey AS BIGINT) AS id FROM nation UNION ALL SELECT 'customers', c_custkey FROM customer WHERE c_nationkey < 12")
def journalled_commit(s, d):
    """Two stores after a commit over both, and another one that fails at its second table and is taken back."""
    root = folder(s, "commits")
    a, b = f"{root}/nations", f"{root}/customers"
    nations, customers = read(s, d, "nation").select(F.col("n_nationkey").cast("long").alias("id")), read(s, d, "customer")
    journal.commit(root, {a: {"t": nations}, b: {"t": customers.filter("c_nationkey < 12").select(F.col("c_custkey").alias("id"))}})
    bad = customers.select(F.when(F.col("c_custkey") >= 0, F.raise_error(F.lit("injected"))).cast("long").alias("id"))
    try:
        journal.commit(root, {a: {"t": nations.limit(0)}, b: {"t": bad}})
        raise AssertionError("the commit should have failed")
    except Exception as error:
        if "injected" not in str(error):
            raise
    journal.recover(root)
    return store.load(s, a, "t").select(F.lit("nations").alias("store"), "id").union(store.load(s, b, "t").select(F.lit("customers"), "id"))
