"""Lifecycle queries over the operational tables, with their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import curation
from ..operators import evidence, history, lifecycle as L, retention
from ..sources import payload, store, tables as T
from ..sources.work import shared_folder
from ..sources.tables import AS_OF, CHAT_SQL, DOCUMENTS_SQL, FEEDBACK_SQL, SESSIONS_SQL, USERS_SQL, with_sql

QUERIES, ORACLES = {}, {}
C, CS, CSU, D = with_sql(CHAT_SQL), with_sql(CHAT_SQL, SESSIONS_SQL), with_sql(CHAT_SQL, SESSIONS_SQL, USERS_SQL), with_sql(DOCUMENTS_SQL)
NOW = f"TIMESTAMP '{AS_OF}'"
STAMP = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss")
STAMP_SQL = lambda c: f"strftime({c}, '%Y-%m-%d %H:%M:%S')"


def query(sql):
    def register(f):
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = sql
        return f

    return register


@query(f"{C} SELECT count(*) AS logs, count(DISTINCT session_id) AS sessions FROM chat_logs WHERE NOT is_deleted AND id IN (3, 5, 8, 13, 21, 34, 55, 89)")
def delete_preview(s, d):
    return L.delete_preview(T.chat_logs(s, d), F.col("id").isin(3, 5, 8, 13, 21, 34, 55, 89))


CHOSEN = "(user_id = 4 OR session_id LIKE '%-2024-01-07')"
DELETED = f"n AS (SELECT * REPLACE (is_deleted OR {CHOSEN} AS is_deleted, CASE WHEN NOT is_deleted AND {CHOSEN} THEN 'batch-x' ELSE batch_id END AS batch_id) FROM chat_logs)"


def _deleted(s, d):
    chosen = (F.col("user_id") == 4) | F.col("session_id").like("%-2024-01-07")
    return L.bulk_delete(T.chat_logs(s, d), chosen, "batch-x", 1, AS_OF)


@query(f"{with_sql(CHAT_SQL, DELETED)} SELECT id, is_deleted, batch_id FROM n")
def bulk_delete(s, d):
    return _deleted(s, d).select("id", "is_deleted", "batch_id")


@query(
    f"{with_sql(CHAT_SQL, SESSIONS_SQL, DELETED)} SELECT session_id, is_deleted OR e AS is_deleted, CASE WHEN e THEN 'batch-x' ELSE batch_id END AS batch_id"
    " FROM (SELECT *, NOT is_deleted AND session_id NOT IN (SELECT session_id FROM n WHERE NOT is_deleted) AS e FROM sessions)"
)
def bulk_delete_sessions(s, d):
    return L.cascade(T.sessions(s, d), _deleted(s, d), "batch-x", AS_OF).select("session_id", "is_deleted", "batch_id")


@query(f"{CS} SELECT session_id, user_id FROM sessions WHERE NOT is_deleted AND session_id NOT IN (SELECT session_id FROM chat_logs WHERE NOT is_deleted)")
def empty_sessions(s, d):
    return L.empty_sessions(T.sessions(s, d), T.chat_logs(s, d)).select("session_id", "user_id")


@query(f"{CS} SELECT batch_id FROM chat_logs WHERE is_deleted UNION SELECT batch_id FROM sessions WHERE is_deleted")
def trash_batch_ids(s, d):
    return L.batch_ids(T.chat_logs(s, d), T.sessions(s, d))


@query(
    f"{CS} SELECT batch_id, {STAMP_SQL('max(deleted_at)')} AS deleted_at, CAST(sum(log) AS BIGINT) AS logs, count(DISTINCT session_id) AS sessions,"
    " left(arg_min(question, created_at), 120) AS preview,"
    " CASE WHEN bool_and(own) THEN 'self_service' WHEN count(own) > 0 THEN 'admin' ELSE 'unknown' END AS deletion_source"
    " FROM (SELECT batch_id, deleted_at, session_id, 1 AS log, question, created_at, deleted_by = user_id AS own FROM chat_logs WHERE is_deleted"
    " UNION ALL SELECT batch_id, deleted_at, session_id, 0, NULL, NULL, NULL FROM sessions WHERE is_deleted) GROUP BY batch_id"
)
def trash_batches(s, d):
    out = L.trash_batches(T.chat_logs(s, d), T.sessions(s, d))
    return out.withColumn("deleted_at", STAMP("deleted_at"))


@query(
    f"{with_sql(USERS_SQL)} SELECT u.user_id, u.username, {STAMP_SQL('u.deleted_at')} AS deleted_at, coalesce(a.username, 'Unknown') AS actor,"
    " CASE WHEN u.deleted_by IS NULL THEN 'unknown' WHEN u.deleted_by = u.user_id THEN 'self_service' ELSE 'admin' END AS deletion_source"
    " FROM users u LEFT JOIN users a ON a.user_id = u.deleted_by WHERE u.is_deleted AND u.purged_at IS NULL"
)
def trash_users(s, d):
    return L.trash_users(T.users(s, d)).withColumn("deleted_at", STAMP("deleted_at"))


OWNERS = "o AS (SELECT DISTINCT session_id FROM chat_logs WHERE batch_id = 'b11')"


@query(
    f"{with_sql(CHAT_SQL, SESSIONS_SQL, OWNERS)} SELECT 'chat' AS kind, CAST(id AS VARCHAR) AS key, is_deleted AND batch_id <> 'b11' AS is_deleted FROM chat_logs"
    " UNION ALL SELECT 'session', session_id, is_deleted AND session_id NOT IN (FROM o) FROM sessions"
)
def trash_restore(s, d):
    chats, sessions = L.restore(T.chat_logs(s, d), T.sessions(s, d), "b11")
    return chats.select(F.lit("chat").alias("kind"), F.col("id").cast("string").alias("key"), "is_deleted").union(
        sessions.select(F.lit("session"), "session_id", "is_deleted")
    )


@query(
    f"{with_sql(CHAT_SQL, SESSIONS_SQL)}, k AS (SELECT * FROM chat_logs WHERE batch_id IS DISTINCT FROM 'b11'), t AS (SELECT session_id FROM chat_logs WHERE batch_id = 'b11')"
    " SELECT 'chat' AS kind, CAST(id AS VARCHAR) AS key FROM k UNION ALL SELECT 'session', session_id FROM sessions"
    " WHERE session_id NOT IN (FROM t) OR session_id IN (SELECT session_id FROM k)"
)
def trash_hard_delete(s, d):
    chats, sessions = L.hard_delete(T.chat_logs(s, d), T.sessions(s, d), "b11")
    return chats.select(F.lit("chat").alias("kind"), F.col("id").cast("string").alias("key")).union(sessions.select(F.lit("session"), "session_id"))


@query(
    f"{CS} SELECT c.id, c.is_deleted OR s.is_deleted AS is_deleted, coalesce(c.batch_id, s.batch_id) AS batch_id FROM chat_logs c JOIN sessions s USING (session_id)"
)
def trash_propagate(s, d):
    return L.propagate(T.chat_logs(s, d), T.sessions(s, d)).select("id", "is_deleted", "batch_id")


@query(f"{with_sql(USERS_SQL)} SELECT user_id, username FROM users WHERE is_deleted AND purged_at IS NULL AND deleted_at <= TIMESTAMP '2024-02-10 12:00:00' - INTERVAL 30 DAY")
def retention_candidates(s, d):
    due = F.col("is_deleted") & F.col("purged_at").isNull() & L.expired("2024-02-10 12:00:00")
    return T.users(s, d).filter(due).select("user_id", "username")


@query(
    f"{CS} SELECT batch_id FROM chat_logs WHERE is_deleted AND deleted_at <= TIMESTAMP '2024-02-10 12:00:00' - INTERVAL 30 DAY"
    " UNION SELECT batch_id FROM sessions WHERE is_deleted AND deleted_at <= TIMESTAMP '2024-02-10 12:00:00' - INTERVAL 30 DAY"
)
def retention_batches(s, d):
    old = L.expired("2024-02-10 12:00:00")
    return L.batch_ids(T.chat_logs(s, d).filter(old), T.sessions(s, d).filter(old))


@query(
    f"{with_sql(USERS_SQL)} SELECT user_id, CASE WHEN due THEN 'deleted_' || lower(to_hex(user_id)) ELSE username END AS username,"
    " CASE WHEN due THEN 'deleted_' || lower(to_hex(user_id)) || '@deleted.invalid' ELSE email END AS email, purged_at IS NOT NULL OR due AS purged"
    " FROM (SELECT *, is_deleted AND purged_at IS NULL AND deleted_at <= TIMESTAMP '2024-02-10 12:00:00' - INTERVAL 30 DAY AS due FROM users)"
)
def anonymize_users(s, d):
    out = L.anonymise(T.users(s, d), "2024-02-10 12:00:00")
    return out.select("user_id", "username", "email", F.col("purged_at").isNotNull().alias("purged"))


@query("SELECT lower(trim(s_name)) AS identity, count(*) AS n FROM (SELECT '  ' || upper(r_name) AS s_name FROM region UNION ALL SELECT r_name FROM region UNION ALL SELECT n_name FROM nation) GROUP BY 1 HAVING count(*) > 1")
def identity_duplicates(s, d):
    r, n = T.read(s, d, "region"), T.read(s, d, "nation")
    names = r.select(F.concat(F.lit("  "), F.upper("r_name")).alias("username")).union(r.select("r_name")).union(n.select("n_name"))
    return L.duplicate_identities(names, "username")


@query(f"{with_sql(USERS_SQL)} SELECT user_id, trim(username) AS username, lower(trim(email)) AS email, trim(username) IS DISTINCT FROM username OR lower(trim(email)) IS DISTINCT FROM email AS changed FROM users")
def identity_normalize(s, d):
    return L.normalise_identities(T.users(s, d))


@query(f"{with_sql(USERS_SQL)} SELECT user_id, coalesce(regexp_full_match(lower(trim(email)), '[a-z0-9._%+-]+@(example\\.com|example\\.org)'), false) AS allowed FROM users")
def allowed_addresses(s, d):
    return L.allowed_addresses(T.users(s, d), ["example.com", "example.org"])


@query(f"{D} SELECT upper(file_name) AS file_name, arg_min(file_name, id) AS existing_name FROM stored GROUP BY lower(file_name), upper(file_name) HAVING upper(file_name) <> arg_min(file_name, id)")
def case_collisions(s, d):
    stored = T.catalogue_documents(s, d)
    return L.case_collisions(stored.select(F.upper("file_name").alias("file_name")).distinct(), stored)


SRC = "(SELECT 'src' || n_nationkey AS source FROM nation)"


@query(f"SELECT upper(source) AS source FROM {SRC} WHERE lower(source) NOT IN (SELECT lower(source) FROM documents)")
def unindexed_sources(s, d):
    required = T.read(s, d, "nation").select(F.upper(F.concat(F.lit("src"), F.col("n_nationkey").cast("string"))).alias("source"))
    return L.unindexed(required, T.read(s, d, "documents").select("source"))


@query(f"SELECT source FROM {SRC} EXCEPT SELECT source FROM documents")
def new_documents(s, d):
    asked = T.read(s, d, "nation").select(F.concat(F.lit("src"), F.col("n_nationkey").cast("string")).alias("source"))
    return asked.subtract(T.read(s, d, "documents").select("source"))


SYNC_SQL = """, listing AS (SELECT 'src' || n_nationkey AS file_name, 1000 + n_nationkey AS file_size, sha256(n_name) AS checksum FROM nation WHERE n_nationkey < 22),
old AS (SELECT 'src' || n_nationkey AS file_name, 5 AS file_size, 'old' AS checksum, 'indexing' AS status, 0 AS chunk_count FROM nation WHERE n_nationkey % 2 = 0),
counts AS (SELECT source AS file_name, count(*) AS found FROM documents GROUP BY 1)
SELECT file_name, CAST(coalesce(o.file_size, l.file_size) AS BIGINT) AS file_size, coalesce(o.checksum, l.checksum) AS checksum,
CASE WHEN l.file_name IS NULL THEN o.status WHEN found > 0 THEN 'ready' ELSE 'failed' END AS status,
CAST(CASE WHEN l.file_name IS NULL THEN o.chunk_count ELSE coalesce(found, 0) END AS BIGINT) AS chunk_count
FROM old o FULL JOIN listing l USING (file_name) LEFT JOIN counts USING (file_name)"""


@query("WITH z AS (SELECT 1)" + SYNC_SQL)
def document_sync(s, d):
    n = T.read(s, d, "nation").withColumn("file_name", F.concat(F.lit("src"), F.col("n_nationkey").cast("string")))
    listing = n.filter("n_nationkey < 22").select("file_name", (F.col("n_nationkey") + 1000).cast("long").alias("file_size"), F.sha2("n_name", 256).alias("checksum"))
    old = n.filter("n_nationkey % 2 = 0").select("file_name", F.lit(5).cast("long").alias("file_size"), F.lit("old").alias("checksum"), F.lit("indexing").alias("status"), F.lit(0).alias("chunk_count"))
    return L.sync_documents(listing, old, T.read(s, d, "documents").select("source"))


@query("SELECT source, count(*) AS chunks FROM documents GROUP BY source")
def chunk_counts(s, d):
    return T.read(s, d, "documents").groupBy("source").agg(F.count("*").alias("chunks"))


@query("SELECT doc_id, sha256(text) AS checksum FROM documents")
def doc_checksums(s, d):
    return T.read(s, d, "documents").select("doc_id", F.sha2("text", 256).alias("checksum"))


@query(
    f"{with_sql(CHAT_SQL, USERS_SQL, FEEDBACK_SQL)} SELECT chat_id, rating, comment, question, a.username AS author, r.username AS resolver FROM feedback f"
    " LEFT JOIN chat_logs c ON c.id = chat_id LEFT JOIN users a USING (user_id) LEFT JOIN users r ON r.user_id = resolved_by"
    " WHERE NOT f.is_deleted AND rating = 'like' AND (comment ILIKE '%1_2%' OR question ILIKE '%1_2%' OR answer ILIKE '%1_2%' OR a.username ILIKE '%1_2%' OR a.email ILIKE '%1_2%')"
)
def feedback_search(s, d):
    return L.search_feedback(T.feedback(s, d), T.chat_logs(s, d), T.users(s, d), "1_2", "like")


def _noted(s, d):
    """Feedback with the time at which it was resolved."""
    return T.feedback(s, d).withColumn("resolved_at", F.when(F.col("is_resolved"), F.lit(AS_OF).cast("timestamp_ntz")))


@query(
    f"{with_sql(FEEDBACK_SQL)} SELECT chat_id, is_deleted, CASE WHEN acts THEN chat_id % 4 = 0 ELSE is_resolved END AS is_resolved,"
    " CASE WHEN acts AND chat_id % 4 = 0 THEN 7 WHEN NOT acts THEN resolved_by END AS resolved_by,"
    f" CASE WHEN acts AND chat_id % 4 = 0 THEN 'later' WHEN NOT acts AND is_resolved THEN 'before' END AS resolved FROM (SELECT *, chat_id % 2 = 0 AND NOT is_deleted AS acts FROM feedback)"
)
def feedback_resolve(s, d):
    """Every second feedback is resolved and then, unless its number is a multiple of four, opened again."""
    f = _noted(s, d)
    at = lambda day: F.lit(AS_OF).cast("timestamp_ntz") + F.expr(f"interval {day} day")
    even = f.filter("chat_id % 2 = 0").select("chat_id", F.lit(7).cast("long").alias("by"))
    first = even.select("chat_id", F.lit(True).alias("is_resolved"), "by", at(1).alias("at"))
    again = even.filter("chat_id % 4 <> 0").select("chat_id", F.lit(False).alias("is_resolved"), "by", at(2).alias("at"))
    out = L.resolve_feedback(f, first.union(again))
    when = F.when(F.col("resolved_at") == at(0), "before").when(F.col("resolved_at").isNotNull(), "later")
    return out.select("chat_id", "is_deleted", "is_resolved", "resolved_by", when.alias("resolved"))


@query(f"{with_sql(FEEDBACK_SQL)} SELECT chat_id, is_deleted OR chat_id IN (SELECT o_orderkey FROM orders) AS is_deleted FROM feedback")
def feedback_delete(s, d):
    ids = T.read(s, d, "orders").select(F.col("o_orderkey").alias("chat_id"))
    return L.delete_feedback(T.feedback(s, d), ids).select("chat_id", "is_deleted")


@query("SELECT user_id * 100 + event_id % 7 AS chat_id, arg_max(CASE WHEN value > 50 THEN 'like' ELSE 'dislike' END, event_id) AS rating, max(event_id) AS event_id FROM events GROUP BY 1")
def feedback_latest(s, d):
    e = T.read(s, d, "events")
    rated = e.select((F.col("user_id") * 100 + F.col("event_id") % 7).alias("chat_id"), F.col("ts").alias("created_at"), "event_id", F.when(F.col("value") > 50, "like").otherwise("dislike").alias("rating"))
    return L.latest_feedback(rated)


@query(
    f"{C} SELECT session_id, id, 0 AS n, 'user' AS role, question AS content FROM chat_logs WHERE NOT is_deleted UNION ALL"
    " SELECT session_id, id, 1, 'assistant', answer FROM chat_logs WHERE NOT is_deleted AND answer <> ''"
)
def session_history(s, d):
    return L.session_history(T.chat_logs(s, d)).drop("created_at")


@query(f"{with_sql(USERS_SQL)} SELECT count(*) = 0 AS last_admin FROM users WHERE role = 'admin' AND NOT is_deleted AND user_id <> 3")
def last_admin_guard(s, d):
    return L.is_last_admin(T.users(s, d), 3)


@query(f"{D} SELECT status, CAST(sum(file_size) AS BIGINT) AS bytes, count(*) AS files FROM stored GROUP BY status")
def storage_totals(s, d):
    return T.catalogue_documents(s, d).groupBy("status").agg(F.sum("file_size").alias("bytes"), F.count("*").alias("files"))


#: Sizes from bytes to hundreds of MB: the last digit of the id says how often a size is taken times 11.
SIZES = "file_size * CAST(pow(11, id % 6) AS BIGINT) // 121"


@query(
    f"{D} SELECT id, CASE WHEN n < 1024 THEN n || ' B' WHEN n < 1048576 THEN format('{{:.1f}} KB', floor(n * 10 / 1024 + 0.5) / 10)"
    " ELSE format('{:.1f} MB', floor(n * 10 / 1048576 + 0.5) / 10) END AS label"
    f" FROM (SELECT id, CAST({SIZES} AS BIGINT) AS n FROM stored)"
)
def size_labels(s, d):
    sizes = F.floor(F.col("file_size") * F.pow(F.lit(11), F.col("id") % 6).cast("long") / 121).cast("long")
    return T.catalogue_documents(s, d).select("id", curation.size_label(sizes).alias("label"))


def _card_versions(s, d):
    """Three versions of cards made of customers: the first, one with unwanted changes, and a later one."""
    first = T.read(s, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"), F.round(F.col("c_acctbal") * 100).cast("long").alias("cents"))
    changed = first.filter("id % 10 <> 9").select("id", F.expr("if(id % 3 = 0, concat(upper(name), '!'), name)").alias("name"), "segment", F.expr("if(id % 4 = 0, null, cents)").alias("cents"))
    second = changed.union(first.filter("id % 50 = 0").select(F.col("id") + 1000001, F.lit("new"), "segment", "cents"))
    third = second.select("id", "name", F.expr("if(id % 5 = 0, 'X', segment)").alias("segment"), F.expr("if(id % 8 = 0, -1, cents)").alias("cents"))
    return first, second, third


CARDS = """one AS (SELECT c_custkey AS id, c_name AS name, c_mktsegment AS segment, CAST(round(c_acctbal * 100) AS BIGINT) AS cents FROM customer),
two AS (SELECT id, CASE WHEN id % 3 = 0 THEN upper(name) || '!' ELSE name END AS name, segment, CASE WHEN id % 4 <> 0 THEN cents END AS cents FROM one WHERE id % 10 <> 9
  UNION ALL SELECT id + 1000001, 'new', segment, cents FROM one WHERE id % 50 = 0),
three AS (SELECT id, name, CASE WHEN id % 5 = 0 THEN 'X' ELSE segment END AS segment, CASE WHEN id % 8 = 0 THEN -1 ELSE cents END AS cents FROM two),
pairs AS (SELECT coalesce(a.id, b.id) AS id, CASE WHEN a.id IS NULL THEN 'added' WHEN b.id IS NULL THEN 'removed' ELSE 'changed' END AS change,
  a.name AS n1, b.name AS n2, a.segment AS s1, b.segment AS s2, CAST(a.cents AS VARCHAR) AS c1, CAST(b.cents AS VARCHAR) AS c2 FROM one a FULL JOIN two b ON a.id = b.id),
edits AS (SELECT id, change, 'name' AS field, n1 AS old, n2 AS new FROM pairs UNION ALL SELECT id, change, 'segment', s1, s2 FROM pairs UNION ALL SELECT id, change, 'cents', c1, c2 FROM pairs),
changes AS (SELECT * FROM edits WHERE old IS DISTINCT FROM new)"""


@query(f"WITH {CARDS} SELECT * FROM changes")
def row_changes(s, d):
    first, second, _ = _card_versions(s, d)
    return history.changes(first, second, ["id"])


@query(
    f"WITH {CARDS} SELECT t.id, coalesce(o.name, t.name) AS name, t.segment, CASE WHEN o.id IS NOT NULL AND t.id % 4 = 0 AND t.id % 8 <> 0 THEN o.cents ELSE t.cents END AS cents"
    " FROM three t LEFT JOIN one o USING (id) WHERE o.id IS NOT NULL OR EXISTS (SELECT 1 FROM two w WHERE w.id = t.id AND (w.segment IS DISTINCT FROM t.segment OR w.cents IS DISTINCT FROM t.cents))"
    " UNION ALL SELECT * FROM one WHERE id % 10 = 9"
)
def row_restore(s, d):
    """The later version without the unwanted changes; what was changed again since stays."""
    first, second, third = _card_versions(s, d)
    return history.taken_back(third, history.changes(first, second, ["id"]), ["id"])[0]


@query(
    f"WITH {CARDS} SELECT t.id, field, old, new, '-1' AS current FROM three t JOIN changes USING (id) WHERE change = 'changed' AND field = 'cents' AND t.id % 8 = 0 AND new IS DISTINCT FROM '-1'"
)
def restore_conflicts(s, d):
    first, second, third = _card_versions(s, d)
    return history.taken_back(third, history.changes(first, second, ["id"]), ["id"], ["cents", "name"])[1]


@query(
    f"{CS}, due AS (SELECT batch_id FROM chat_logs WHERE is_deleted AND deleted_at <= TIMESTAMP '2024-02-10 12:00:00' - INTERVAL 30 DAY"
    " UNION SELECT batch_id FROM sessions WHERE is_deleted AND deleted_at <= TIMESTAMP '2024-02-10 12:00:00' - INTERVAL 30 DAY),"
    " k AS (SELECT * FROM chat_logs WHERE batch_id IS NULL OR batch_id NOT IN (FROM due)),"
    " t AS (SELECT session_id FROM chat_logs WHERE batch_id IN (FROM due) UNION SELECT session_id FROM sessions WHERE batch_id IN (FROM due))"
    " SELECT 'chat' AS kind, CAST(id AS VARCHAR) AS key FROM k UNION ALL SELECT 'session', session_id FROM sessions WHERE session_id NOT IN (FROM t) OR session_id IN (SELECT session_id FROM k)"
)
def retention_job(s, d):
    """Chats and sessions that the retention job leaves, run over a store of the operational tables."""
    root = f"{shared_folder(s)}/retention-{uuid.uuid4().hex}"
    store.install(root, {"chats": T.chat_logs(s, d), "sessions": T.sessions(s, d), "users": T.users(s, d)})
    retention.run(s, root, "2024-02-10 12:00:00")
    left = store.load(s, root, "chats").select(F.lit("chat").alias("kind"), F.col("id").cast("string").alias("key"))
    return left.union(store.load(s, root, "sessions").select(F.lit("session"), "session_id"))


@query(f"{CS} SELECT count(*) AS batches FROM (SELECT batch_id FROM chat_logs WHERE is_deleted GROUP BY 1 HAVING bool_and(deleted_by = user_id))")
def self_service_batches(s, d):
    batches = L.trash_batches(T.chat_logs(s, d), T.sessions(s, d))
    return batches.agg(F.count_if(F.col("deletion_source") == "self_service").alias("batches"))


@query("SELECT user_id, 'question' AS activity_type, '{\"event_id\":' || event_id || ',\"event_type\":\"' || event_type || '\"}' AS metadata FROM events")
def activity_log(s, d):
    return L.activity(T.read(s, d, "events"), "question", "event_id", "event_type")


@query(f"{D} SELECT count(file_name) = count(DISTINCT lower(file_name)) AS unique FROM stored")
def batch_names_unique(s, d):
    return L.names_differ(T.catalogue_documents(s, d))


@query("SELECT 'src' || n_nationkey AS source FROM nation INTERSECT SELECT source FROM documents")
def selected_available(s, d):
    chosen = T.read(s, d, "nation").select(F.concat(F.lit("src"), F.col("n_nationkey").cast("string")).alias("source"))
    return chosen.intersect(T.read(s, d, "documents").select("source"))


@query(f"{CS} SELECT session_id, title FROM sessions WHERE NOT is_deleted AND user_id = 7 AND contains(lower(title), '-01-1') ORDER BY updated_at DESC")
def session_search(s, d):
    mine = T.sessions(s, d).filter(~F.col("is_deleted") & (F.col("user_id") == 7) & F.lower("title").contains("-01-1"))
    return mine.orderBy(F.desc("updated_at")).select("session_id", "title")


def unique_pages(s, d):
    """Pages that conversations show, without look-alikes: the hash of a page differs from that of its conversation in a few or many bits."""
    turns = T.read(s, d, "conversations")
    shift = lambda n: F.expr(f"shiftright(9223372036854775807, 63 - cast({n} as int))")
    phash = F.xxhash64("conv_id").bitwiseXOR(shift("(turn * 11) % 40"))
    return evidence.unique_pages(turns.select(F.col("conv_id").alias("answer_id"), F.col("turn").cast("int").alias("position"), phash.alias("phash")))


QUERIES["unique_pages"] = unique_pages


#: A payload of each conversation: lists of user texts with scores, nested in the turns before, and pairs of other texts.
PAYLOADS = """turns AS (SELECT conv_id, turn, role, to_json(text) AS t, (turn * 7 + conv_id) % 10 AS k FROM conversations WHERE text IS NOT NULL),
level AS (SELECT conv_id, turn, CASE WHEN role = 'user' THEN '{"rec_texts":[' || t || ',"  "],"rec_scores":[0.' || k || '],"page":{"turn":' || turn || '}}'
  ELSE '{"a":{"blocks":[[' || t || ',0.' || k || '],[[' || t || ',1],"' || role || '"]]}}' END AS j FROM turns)"""


@query(
    f"WITH {PAYLOADS}, payloads AS (SELECT conv_id, '[' || string_agg(j, ',' ORDER BY turn, j) || ']' AS p FROM level GROUP BY 1),"
    " nodes AS (SELECT conv_id, key, value, type, id, parent FROM payloads, json_tree(p::JSON)),"
    " listed AS (SELECT t.conv_id, json_extract_string(t.value, '$') AS text, coalesce(CAST(json_extract(s.value, '$[' || t.key || ']') AS DOUBLE), 1.0) AS score"
    "  FROM nodes l JOIN nodes t ON t.conv_id = l.conv_id AND t.parent = l.id LEFT JOIN nodes s ON s.conv_id = l.conv_id AND s.parent = l.parent AND s.key = 'rec_scores' WHERE l.key = 'rec_texts'),"
    " paired AS (SELECT conv_id, json_extract_string(value, '$[0]') AS text, CAST(json_extract(value, '$[1]') AS DOUBLE) AS score FROM nodes"
    "  WHERE type = 'ARRAY' AND coalesce(key, '') NOT IN ('rec_texts', 'rec_scores') AND json_array_length(value) = 2 AND json_type(value, '$[0]') = 'VARCHAR' AND json_type(value, '$[1]') IN ('UBIGINT', 'BIGINT', 'DOUBLE'))"
    " SELECT conv_id, trim(text, ' ') AS text, count(*) AS n FROM (FROM listed UNION ALL FROM paired) WHERE score >= 0.5 AND (trim(text, ' ') <> '') GROUP BY 1, 2"
)
def payload_texts(s, d):
    """Texts with a score of 0.5 or more in nested payloads made of conversations."""
    text = F.expr("substring(to_json(struct(text)), 9, length(to_json(struct(text))) - 9)")
    k = ((F.col("turn") * 7 + F.col("conv_id")) % 10).cast("string")
    listed = F.concat(F.lit('{"rec_texts":['), text, F.lit(',"  "],"rec_scores":[0.'), k, F.lit('],"page":{"turn":'), F.col("turn").cast("string"), F.lit("}}"))
    paired = F.concat(F.lit('{"a":{"blocks":[['), text, F.lit(",0."), k, F.lit("],[["), text, F.lit(',1],"'), "role", F.lit('"]]}}'))
    turns = T.read(s, d, "conversations").filter("text is not null").select("conv_id", "turn", F.when(F.col("role") == "user", listed).otherwise(paired).alias("j"))
    whole = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "j"))).alias("l"))
    payloads = whole.select(F.col("conv_id").alias("id"), F.concat(F.lit("["), F.array_join(F.transform("l", lambda x: x["j"]), ","), F.lit("]")).alias("payload"))
    return payload.texts(payloads, 0.5).filter("text <> ''").groupBy(F.col("id").alias("conv_id"), "text").agg(F.count("*").alias("n"))
