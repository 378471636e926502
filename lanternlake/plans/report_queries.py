"""Report queries over the operational tables, with their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import reports as R
from ..sources import tables as T
from ..sources.work import shared_folder
from ..streaming import online, refresh, replay
from ..sources.tables import AS_OF, CHAT_SQL, DOCUMENTS_SQL, FEEDBACK_SQL, TOPICS_SQL, USERS_SQL, with_sql

START, END = "2024-01-05", "2024-01-24"
LIVE = "NOT is_deleted AND created_at >= TIMESTAMP '2024-01-04 17:00:00' AND created_at < TIMESTAMP '2024-01-24 17:00:00'"
CHAT = with_sql(CHAT_SQL)
CHAT_USERS = with_sql(CHAT_SQL, USERS_SQL)
QUERIES, ORACLES = {}, {}


def query(sql: str | None = None, name: str | None = None):
    def register(f):
        QUERIES[name or f.__name__] = f
        if sql:
            ORACLES[name or f.__name__] = sql
        return f

    return register


def chats(s, d, scope="user", topic_id=None):
    return R.chats_between(T.chat_logs(s, d), T.users(s, d), START, END, topic_id, scope)


SCOPED = f"SELECT c.* FROM chat_logs c WHERE {LIVE} AND user_id IN (SELECT user_id FROM users WHERE role = 'user')"
FIGURES = "count(*) AS questions, count(DISTINCT user_id) AS users, sum(CAST(round(latency_ms * 1000) AS BIGINT)) / count(latency_ms) / 1000 AS avg_latency"
DAY = "(CAST(created_at + INTERVAL 7 HOUR AS DATE))"
BUCKET = {
    "day": f"strftime({DAY}, '%Y-%m-%d')",
    "week": f"strftime(date_trunc('week', {DAY}), '%Y-W%W')",
    "month": f"strftime({DAY}, '%Y-%m')",
    "year": f"strftime({DAY}, '%Y')",
}
for group, label in BUCKET.items():
    QUERIES[f"report_timeline_{group}"] = lambda s, d, g=group: R.timeline(chats(s, d), g)
    ORACLES[f"report_timeline_{group}"] = f"{CHAT_USERS} SELECT {label} AS bucket, {FIGURES} FROM ({SCOPED}) GROUP BY 1"
    QUERIES[f"metrics_{group}"] = lambda s, d, g=group: R.timeline(
        T.chat_logs(s, d).filter(~F.col("is_deleted")).join(T.users(s, d).filter("role = 'manager'").select("user_id"), "user_id"), g
    )
    ORACLES[f"metrics_{group}"] = (
        f"{CHAT_USERS} SELECT {label} AS bucket, {FIGURES} FROM chat_logs c JOIN users u USING (user_id)"
        " WHERE NOT c.is_deleted AND u.role = 'manager' GROUP BY 1"
    )


@query(f"{CHAT_USERS} SELECT count(*) AS questions, count(DISTINCT user_id) AS users, coalesce(sum(CAST(round(latency_ms * 1000) AS BIGINT)) / count(latency_ms) / 1000, 0.0) AS avg_latency FROM ({SCOPED})")
def report_summary(s, d):
    return R.summary(chats(s, d))


@query(f"{CHAT_USERS} SELECT count(*) AS questions, count(DISTINCT user_id) AS users, coalesce(sum(CAST(round(latency_ms * 1000) AS BIGINT)) / count(latency_ms) / 1000, 0.0) AS avg_latency FROM ({SCOPED}) WHERE topic_id = 3")
def report_topic_filtered(s, d):
    return R.summary(chats(s, d, topic_id=3))


@query(
    f"{with_sql(CHAT_SQL, USERS_SQL, FEEDBACK_SQL)}, f AS (SELECT count(*) FILTER (rating = 'like') AS likes, count(*) FILTER (rating = 'dislike') AS dislikes"
    " FROM feedback WHERE NOT is_deleted AND chat_id IN (SELECT id FROM chat_logs WHERE NOT is_deleted AND created_at >= TIMESTAMP '2023-12-31 17:00:00' AND created_at < TIMESTAMP '2024-01-24 17:00:00')) SELECT likes, dislikes,"
    " coalesce(round(likes * 100.0::DOUBLE / nullif(likes + dislikes, 0), 6), 0.0) AS satisfaction FROM f"
)
def report_feedback(s, d):
    wide = R.chats_between(T.chat_logs(s, d), T.users(s, d), "2024-01-01", END)
    return R.feedback_rates(wide, T.feedback(s, d))


@query(
    f"{with_sql(CHAT_SQL, USERS_SQL, TOPICS_SQL)} SELECT coalesce(name, 'General Guidance') AS topic, count(*) AS questions"
    f" FROM ({SCOPED}) LEFT JOIN topics USING (topic_id) GROUP BY name"
)
def report_topics(s, d):
    return R.by_topic(chats(s, d), T.topics(s))


@query(
    f"{with_sql(CHAT_SQL, TOPICS_SQL)} SELECT name AS topic, count(*) AS questions FROM chat_logs JOIN topics USING (topic_id)"
    " WHERE NOT is_deleted GROUP BY name"
)
def top_topics(s, d):
    live = T.chat_logs(s, d).filter(~F.col("is_deleted")).groupBy("topic_id").agg(F.count("*").alias("questions"))
    return live.join(T.topics(s), "topic_id").select(F.col("name").alias("topic"), "questions")


@query(
    f"{CHAT_USERS} SELECT user_id, username, count(*) AS questions FROM ({SCOPED}) JOIN users USING (user_id)"
    " GROUP BY ALL ORDER BY questions DESC, user_id LIMIT 20"
)
def report_top_users(s, d):
    return R.top_users(chats(s, d), T.users(s, d))


@query(
    f"{with_sql(CHAT_SQL, USERS_SQL, TOPICS_SQL)} SELECT c.id, strftime(created_at + INTERVAL 7 HOUR, '%Y-%m-%d %H:%M:%S') AS asked_at,"
    " CASE WHEN u.is_deleted THEN 'Deleted user' ELSE coalesce(username, 'Unknown') END AS username,"
    f" coalesce(name, 'General Guidance') AS topic, question, latency_ms FROM (SELECT * FROM chat_logs WHERE {LIVE}) c"
    " LEFT JOIN users u USING (user_id) LEFT JOIN topics t USING (topic_id) ORDER BY created_at DESC, c.id DESC LIMIT 50001"
)
def report_details(s, d):
    return R.details(chats(s, d, "all"), T.users(s, d), T.topics(s))


@query(f"{CHAT_USERS} SELECT user_id, username, count(c.id) AS questions FROM users u LEFT JOIN chat_logs c USING (user_id) WHERE c.id IS NULL OR NOT c.is_deleted GROUP BY ALL UNION ALL SELECT user_id, username, 0 FROM users WHERE user_id IN (SELECT user_id FROM chat_logs GROUP BY 1 HAVING bool_and(is_deleted))")
def questions_per_user(s, d):
    return R.questions_per_user(T.users(s, d), T.chat_logs(s, d)).select("user_id", "username", "questions")


@query(
    f"{CHAT_USERS} SELECT user_id, username, role, u.is_deleted, count(c.id) AS questions, strftime(max(c.created_at), '%Y-%m-%d %H:%M:%S') AS last_question"
    " FROM users u LEFT JOIN (SELECT * FROM chat_logs WHERE NOT is_deleted) c USING (user_id) GROUP BY user_id, username, role, u.is_deleted"
)
def list_users(s, d):
    out = R.questions_per_user(T.users(s, d), T.chat_logs(s, d))
    return out.select("user_id", "username", "role", "is_deleted", "questions", F.date_format("last_question", "yyyy-MM-dd HH:mm:ss").alias("last_question"))


def page_sql(where: str, order: str = "created_at DESC, id DESC", offset: int = 0) -> str:
    return (
        f"{with_sql(CHAT_SQL, USERS_SQL, TOPICS_SQL)}, m AS (SELECT c.*, name FROM chat_logs c LEFT JOIN topics USING (topic_id) WHERE NOT is_deleted AND {where}),"
        f" p AS (SELECT * FROM m ORDER BY {order} LIMIT 20 OFFSET {offset}), n AS (SELECT count(*) AS total FROM m)"
        " SELECT p.id, coalesce(username, 'Unknown') AS username, coalesce(name, 'General Guidance') AS topic, question,"
        f" strftime(created_at + INTERVAL 7 HOUR, '%Y-%m-%d %H:%M:%S') AS asked_at, total, total > {offset + 20} AS has_next"
        " FROM p CROSS JOIN n LEFT JOIN users USING (user_id)"
    )


@query(page_sql("created_at >= TIMESTAMP '2023-12-31 17:00:00' AND created_at < TIMESTAMP '2024-01-31 17:00:00'", offset=20))
def chat_log_page(s, d):
    return R.log_page(T.chat_logs(s, d), T.users(s, d), T.topics(s), bounds=R.local_day_bounds(AS_OF, "month"), page=2)


@query(page_sql("(question ILIKE '%item_1%' OR answer ILIKE '%item_1%')", "created_at, id"))
def chat_log_search(s, d):
    return R.log_page(T.chat_logs(s, d), T.users(s, d), T.topics(s), search="item_1", newest=False)


@query(page_sql("(name IS NULL OR name = 'General Guidance')"))
def chat_log_general_topic(s, d):
    return R.log_page(T.chat_logs(s, d), T.users(s, d), T.topics(s), topic="General Guidance")


@query(f"{CHAT} SELECT id, left(question, 120) AS question, left(answer, 200) AS answer FROM chat_logs WHERE user_id = 7 AND NOT is_deleted ORDER BY created_at DESC, id DESC LIMIT 50")
def recent_user_chats(s, d):
    mine = T.chat_logs(s, d).filter((F.col("user_id") == 7) & ~F.col("is_deleted")).orderBy(F.desc("created_at"), F.desc("id")).limit(50)
    return mine.select("id", F.substring("question", 1, 120).alias("question"), F.substring("answer", 1, 200).alias("answer"))


@query(f"{CHAT} SELECT user_id FROM chat_logs WHERE created_at <= TIMESTAMP '2024-01-20 12:00:00' GROUP BY user_id HAVING max(created_at) >= TIMESTAMP '2024-01-20 11:00:00'")
def online_users(s, d):
    return R.online_users(T.chat_logs(s, d), AS_OF, minutes=60)


@query(
    f"{with_sql(CHAT_SQL, USERS_SQL, FEEDBACK_SQL, DOCUMENTS_SQL)} SELECT * FROM (SELECT count_if(NOT is_deleted) AS users, count_if(is_deleted) AS deleted_users,"
    " count_if(role = 'admin' AND NOT is_deleted) AS admins FROM users), (SELECT count(*) AS questions FROM chat_logs WHERE NOT is_deleted),"
    " (SELECT count_if(rating = 'like') AS likes, count_if(rating = 'dislike') AS dislikes FROM feedback WHERE NOT is_deleted),"
    " (SELECT count(*) AS documents FROM stored WHERE status <> 'deleted'), (SELECT count(*) AS online FROM (SELECT user_id FROM chat_logs"
    " WHERE created_at <= TIMESTAMP '2024-01-20 12:00:00' GROUP BY 1 HAVING max(created_at) >= TIMESTAMP '2024-01-20 11:55:00'))"
)
def stats_kpis(s, d):
    return R.kpis(T.users(s, d), T.chat_logs(s, d), T.feedback(s, d), T.catalogue_documents(s, d), AS_OF)


@query("SELECT strftime(o_orderdate, '%Y-%m') AS bucket, count(*) AS orders, count(DISTINCT o_custkey) AS customers, round(avg(o_totalprice), 2) AS avg_price FROM orders GROUP BY 1")
def order_timeline_month(s, d):
    return T.read(s, d, "orders").groupBy(F.date_format("o_orderdate", "yyyy-MM").alias("bucket")).agg(
        F.count("*").alias("orders"), F.countDistinct("o_custkey").alias("customers"), F.round(F.avg("o_totalprice"), 2).alias("avg_price")
    )


@query("SELECT o_custkey AS customer, c_name AS name, count(*) AS orders FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY ALL ORDER BY orders DESC, customer LIMIT 20")
def top_customers(s, d):
    counts = T.read(s, d, "orders").groupBy(F.col("o_custkey").alias("customer")).agg(F.count("*").alias("orders"))
    names = T.read(s, d, "customer").select(F.col("c_custkey").alias("customer"), F.col("c_name").alias("name"))
    return counts.join(names, "customer").orderBy(F.desc("orders"), "customer").limit(20)


@query("SELECT l_returnflag, l_linestatus, CAST(round(sum(l_quantity)) AS BIGINT) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 0) AS revenue, count(*) AS n FROM lineitem GROUP BY ALL")
def line_summary(s, d):
    return T.read(s, d, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(
        F.round(F.sum("l_quantity")).cast("long").alias("sum_qty"),
        F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 0).alias("revenue"),
        F.count("*").alias("n"),
    )


@query(f"{with_sql(DOCUMENTS_SQL)} SELECT count_if(status = 'ready') AS ready, count_if(status = 'indexing') AS indexing, count_if(status = 'failed') AS failed, count(*) AS total FROM stored WHERE status <> 'deleted'")
def document_status(s, d):
    return R.status_counts(T.catalogue_documents(s, d))


@query(f"{with_sql(DOCUMENTS_SQL, USERS_SQL)} SELECT id, file_name, file_size, status, chunk_count, username AS uploader FROM stored LEFT JOIN users ON user_id = uploaded_by WHERE status <> 'deleted'")
def document_list(s, d):
    docs = T.catalogue_documents(s, d).filter(F.col("status") != "deleted")
    names = T.users(s, d).select(F.col("user_id").alias("uploaded_by"), F.col("username").alias("uploader"))
    return docs.join(names, "uploaded_by", "left").select("id", "file_name", "file_size", "status", "chunk_count", "uploader")


@query(f"{with_sql(USERS_SQL)} SELECT user_id, username FROM users WHERE NOT is_deleted AND (contains(lower(username), '#00000000') OR contains(lower(email), '.0000000'))")
def user_search(s, d):
    hit = F.lower("username").contains("#00000000") | F.lower("email").contains(".0000000")
    return T.users(s, d).filter(~F.col("is_deleted") & hit).select("user_id", "username")


@query("SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS events FROM events GROUP BY 1, 2")
def events_replay(s, d):
    """Structured Streaming over the event files, to their end. Days are those of the session zone, UTC here."""
    return replay.replay(s, d)


@query(
    f"{CHAT} SELECT user_id FROM chat_logs WHERE created_at <= TIMESTAMP '{AS_OF}' GROUP BY 1 HAVING max(created_at) >= TIMESTAMP '{AS_OF}' - INTERVAL 60 MINUTE"
)
def online_stream(s, d):
    """Users online at a time, from exact stretches that a stateful stream over the event files keeps."""
    return online.replay_online(s, d, AS_OF, 60)


def _live_chats(events):
    return T.chat_rows(events.withColumn("ts", F.col("ts").cast("timestamp_ntz"))).filter(~F.col("is_deleted"))


@query(f"{CHAT} SELECT {BUCKET['day']} AS bucket, {FIGURES} FROM chat_logs WHERE NOT is_deleted GROUP BY 1")
def timeline_refreshed(s, d):
    """Daily figures of all live chats, kept by a stream over the event files."""
    root = f"{shared_folder(s)}/timeline-{uuid.uuid4().hex}"
    refresh.keep_figures(replay.events(s, d), root, _live_chats, None).awaitTermination()
    return refresh.figures(s, root)
