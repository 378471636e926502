"""Operational tables (users, chat logs, sessions, topics, feedback, documents) over the star schema.

Each is a projection of one base table, so filters and column pruning reach its Parquet scan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .work import small_batches

GENERAL_TOPIC = "General Guidance"
#: Known topics; events of other types have none.
TOPICS = [(1, "click"), (2, "view"), (3, "purchase"), (4, "error")]
#: The moment that "now" stands for.
AS_OF = "2024-01-20 12:00:00"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def users(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read(spark, sf_dir, "customer")
    deleted = F.col("c_acctbal") < 0
    return c.select(
        F.col("c_custkey").alias("user_id"),
        F.col("c_name").alias("username"),
        F.concat(F.lit("  "), F.regexp_replace("c_name", "#", "."), F.lit("@Example.COM ")).alias("email"),
        F.when(F.col("c_mktsegment") == "MACHINERY", "manager")
        .when(F.col("c_mktsegment") == "FURNITURE", "admin")
        .otherwise("user")
        .alias("role"),
        deleted.alias("is_deleted"),
        F.when(deleted, F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(cast(c_custkey % 40 as int))")).alias("deleted_at"),
        F.when(deleted & (F.col("c_custkey") % 5 == 0), F.expr("timestamp_ntz'2024-01-15 00:00:00'")).alias("purged_at"),
        F.when(deleted, F.when(F.col("c_custkey") % 3 == 0, F.col("c_custkey")).otherwise(F.col("c_custkey") % 7)).alias("deleted_by"),
    )


USERS_SQL = """users AS (SELECT c_custkey AS user_id, c_name AS username,
  '  ' || replace(c_name, '#', '.') || '@Example.COM ' AS email,
  CASE c_mktsegment WHEN 'MACHINERY' THEN 'manager' WHEN 'FURNITURE' THEN 'admin' ELSE 'user' END AS role,
  c_acctbal < 0 AS is_deleted,
  CASE WHEN c_acctbal < 0 THEN TIMESTAMP '2024-01-01' + to_days(CAST(c_custkey % 40 AS INT)) END AS deleted_at,
  CASE WHEN c_acctbal < 0 AND c_custkey % 5 = 0 THEN TIMESTAMP '2024-01-15' END AS purged_at,
  CASE WHEN c_acctbal < 0 THEN CASE WHEN c_custkey % 3 = 0 THEN c_custkey ELSE c_custkey % 7 END END AS deleted_by
  FROM customer)"""


def topics(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(TOPICS, "topic_id int, name string")


TOPICS_SQL = """topics(topic_id, name) AS (VALUES (1, 'click'), (2, 'view'), (3, 'purchase'), (4, 'error'))"""


def chat_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_rows(read(spark, sf_dir, "events"))


def chat_rows(e: DataFrame) -> DataFrame:
    """Events as chats."""
    k = F.get_json_object("props", "$.k").cast("int")
    topic = F.coalesce(*(F.when(F.col("event_type") == n, F.lit(i)) for i, n in TOPICS))
    deleted = k % 10 == 0
    return e.select(
        F.col("event_id").alias("id"),
        "user_id",
        F.concat_ws(" ", F.lit("how to"), "event_type", F.concat(F.lit("item_"), k.cast("string"))).alias("question"),
        F.concat_ws(" ", F.lit("answer"), F.col("event_id").cast("string"), "event_type").alias("answer"),
        F.col("ts").alias("created_at"),
        F.col("value").alias("latency_ms"),
        topic.alias("topic_id"),
        F.concat(F.col("user_id").cast("string"), F.lit("-"), F.date_format("ts", "yyyy-MM-dd")).alias("session_id"),
        deleted.alias("is_deleted"),
        F.when(deleted, F.col("ts") + F.expr("interval 1 day")).alias("deleted_at"),
        F.when(deleted, F.when(k % 20 == 0, F.col("user_id")).otherwise(F.lit(1))).alias("deleted_by"),
        F.when(deleted, F.concat(F.lit("b"), (F.col("event_id") % 97).cast("string"))).alias("batch_id"),
    )


CHAT_SQL = """chat_logs AS (SELECT event_id AS id, user_id, 'how to ' || event_type || ' item_' || k AS question,
  'answer ' || event_id || ' ' || event_type AS answer, ts AS created_at, value AS latency_ms,
  CASE event_type WHEN 'click' THEN 1 WHEN 'view' THEN 2 WHEN 'purchase' THEN 3 WHEN 'error' THEN 4 END AS topic_id,
  user_id || '-' || strftime(ts, '%Y-%m-%d') AS session_id, k % 10 = 0 AS is_deleted,
  CASE WHEN k % 10 = 0 THEN ts + INTERVAL 1 DAY END AS deleted_at,
  CASE WHEN k % 10 = 0 THEN CASE WHEN k % 20 = 0 THEN user_id ELSE 1 END END AS deleted_by,
  CASE WHEN k % 10 = 0 THEN 'b' || (event_id % 97) END AS batch_id
  FROM (SELECT *, CAST(regexp_extract(props, '"k": ?([0-9]+)', 1) AS INT) AS k FROM events))"""


def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per user and day; sessions whose user id is a multiple of 11 are deleted in a batch."""
    s = chat_logs(spark, sf_dir).groupBy("session_id", "user_id").agg(F.max("created_at").alias("updated_at"))
    deleted = F.col("user_id") % 11 == 0
    return s.select(
        "session_id",
        "user_id",
        F.concat(F.lit("Session "), "session_id").alias("title"),
        "updated_at",
        deleted.alias("is_deleted"),
        F.when(deleted, F.concat(F.lit("s"), (F.col("user_id") % 97).cast("string"))).alias("batch_id"),
        F.when(deleted, F.col("updated_at")).alias("deleted_at"),
    )


SESSIONS_SQL = """sessions AS (SELECT session_id, user_id, 'Session ' || session_id AS title, max(created_at) AS updated_at,
  user_id % 11 = 0 AS is_deleted, CASE WHEN user_id % 11 = 0 THEN 's' || (user_id % 97) END AS batch_id,
  CASE WHEN user_id % 11 = 0 THEN max(created_at) END AS deleted_at
  FROM chat_logs GROUP BY session_id, user_id)"""


def feedback(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = read(spark, sf_dir, "labels")
    return l.select(
        F.col("doc_id").alias("chat_id"),
        F.when(F.col("quality") == 1, "like").otherwise("dislike").alias("rating"),
        F.concat(F.lit("comment "), F.col("doc_id").cast("string")).alias("comment"),
        (F.col("doc_id") % 3 == 0).alias("is_resolved"),
        (F.col("toxic") == 1).alias("is_deleted"),
        F.when(F.col("doc_id") % 3 == 0, F.col("doc_id") % 5).alias("resolved_by"),
    )


FEEDBACK_SQL = """feedback AS (SELECT doc_id AS chat_id, CASE WHEN quality = 1 THEN 'like' ELSE 'dislike' END AS rating,
  'comment ' || doc_id AS comment, doc_id % 3 = 0 AS is_resolved, toxic = 1 AS is_deleted,
  CASE WHEN doc_id % 3 = 0 THEN doc_id % 5 END AS resolved_by FROM labels)"""


def catalogue_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Catalogue of stored files, one for each part."""
    p = read(spark, sf_dir, "part")
    status = F.when(F.col("p_size") % 10 == 0, "deleted").when(F.col("p_size") % 7 == 0, "failed").when(F.col("p_size") % 5 == 0, "indexing").otherwise("ready")
    return p.select(
        F.col("p_partkey").alias("id"),
        F.concat("p_name", F.when(F.col("p_partkey") % 2 == 0, ".pdf").otherwise(".PDF")).alias("file_name"),
        (F.col("p_retailprice") * 100).cast("long").alias("file_size"),
        status.alias("status"),
        (F.col("p_partkey") % 200).alias("uploaded_by"),
        F.sha2("p_name", 256).alias("checksum"),
        F.col("p_size").alias("chunk_count"),
    )


DOCUMENTS_SQL = """stored AS (SELECT p_partkey AS id, p_name || CASE WHEN p_partkey % 2 = 0 THEN '.pdf' ELSE '.PDF' END AS file_name,
  CAST(trunc(p_retailprice * 100) AS BIGINT) AS file_size,
  CASE WHEN p_size % 10 = 0 THEN 'deleted' WHEN p_size % 7 = 0 THEN 'failed' WHEN p_size % 5 = 0 THEN 'indexing' ELSE 'ready' END AS status,
  p_partkey % 200 AS uploaded_by, sha256(p_name) AS checksum, p_size AS chunk_count FROM part)"""


def with_sql(*tables: str) -> str:
    """A WITH clause over the named table definitions."""
    return "WITH " + ",\n".join(tables) + "\n"
