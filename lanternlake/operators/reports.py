"""Report operators: reusable chat filters, local-time buckets, roll-ups, top-n and pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.tables import GENERAL_TOPIC

ZONE = "Asia/Ho_Chi_Minh"
MAX_DETAIL_ROWS = 50_000
MAX_REPORT_DAYS = 3_660
LABELS = {"day": "yyyy-MM-dd", "month": "yyyy-MM", "year": "yyyy"}


def check_report(start: str, end: str, group: str, scope: str) -> None:
    """Raise ValueError unless the dates are in order and not too far apart, and the choices exist."""
    from datetime import date

    a, b = date.fromisoformat(start), date.fromisoformat(end)
    if a > b or (b - a).days > MAX_REPORT_DAYS:
        raise ValueError("the report must begin before it ends and span at most 3660 days")
    if group not in ("day", "week", "month", "year") or scope not in ("all", "user", "manager", "admin"):
        raise ValueError("unknown grouping or scope")


def local(ts: Column, zone: str = ZONE) -> Column:
    """Wall-clock time (no zone) of a UTC time, whatever the session zone is."""
    return F.convert_timezone(F.lit("UTC"), F.lit(zone), ts)


def local_bounds(start: str, end: str, zone: str = ZONE) -> tuple[Column, Column]:
    """UTC times of the first midnight and of the midnight after the last day."""
    edge = lambda day, more: F.convert_timezone(
        F.lit(zone), F.lit("UTC"), (F.to_date(F.lit(day)) + F.lit(more)).cast("timestamp_ntz")
    )
    return edge(start, 0), edge(end, 1)


def chats_between(
    chats: DataFrame, users: DataFrame, start: str, end: str, topic_id: int | None = None, scope: str = "all", zone: str = ZONE
) -> DataFrame:
    """Chats that are not deleted, in a half-open range of local days, of a topic and a role.

    A role keeps chats of users with that role, deleted users included, and drops chats without a user;
    ``all`` keeps those. The range is a pair of constants, which Parquet row groups are skipped by.
    """
    low, high = local_bounds(start, end, zone)
    out = chats.filter(~F.col("is_deleted") & (F.col("created_at") >= low) & (F.col("created_at") < high))
    if topic_id is not None:
        out = out.filter(F.col("topic_id") == topic_id)
    if scope != "all":
        out = out.join(users.filter(F.col("role") == scope).select("user_id"), "user_id", "left_semi")
    return out


def mean(column: str) -> Column:
    """Mean of a column, summed in whole thousandths so that no order of rows changes the last digits."""
    return F.sum(F.round(F.col(column) * 1000).cast("long")) / F.count(column) / 1000


def bucket_label(ts: Column, group: str, zone: str = ZONE) -> Column:
    """Label of the local day, Monday week, month or year of a UTC time.

    A week is the year and the number of its Monday's week, weeks before the first Monday being 00.
    """
    day = F.to_date(local(ts, zone))
    if group == "week":
        monday = F.to_date(F.trunc(day, "week"))
        number = F.floor((F.dayofyear(monday) + 6 - F.weekday(monday)) / 7)
        return F.concat(F.date_format(monday, "yyyy"), F.lit("-W"), F.lpad(number.cast("string"), 2, "0"))
    return F.date_format(day, LABELS[group])


def timeline(chats: DataFrame, group: str) -> DataFrame:
    """Questions, distinct users and mean latency in each time bucket."""
    return chats.groupBy(bucket_label(F.col("created_at"), group).alias("bucket")).agg(
        F.count("*").alias("questions"),
        F.countDistinct("user_id").alias("users"),
        mean("latency_ms").alias("avg_latency"),
    )


def summary(chats: DataFrame) -> DataFrame:
    """Questions, distinct users and mean latency, 0 where there is none, in one pass."""
    return chats.agg(
        F.count("*").alias("questions"),
        F.countDistinct("user_id").alias("users"),
        F.coalesce(mean("latency_ms"), F.lit(0.0)).alias("avg_latency"),
    )


def feedback_rates(chats: DataFrame, feedback: DataFrame) -> DataFrame:
    """Likes, dislikes and satisfaction in percent of the feedback on ``chats`` that is not deleted."""
    f = feedback.filter(~F.col("is_deleted")).join(chats.select(F.col("id").alias("chat_id")), "chat_id")
    counts = f.agg(
        *(F.coalesce(F.sum(F.when(F.col("rating") == r, 1).otherwise(0)), F.lit(0)).alias(f"{r}s") for r in ("like", "dislike"))
    )
    rate = F.try_divide(F.col("likes") * 100.0, F.col("likes") + F.col("dislikes"))
    return counts.withColumn("satisfaction", F.coalesce(F.round(rate, 6), F.lit(0.0)))


def by_topic(chats: DataFrame, topics: DataFrame) -> DataFrame:
    """Questions of each topic; without a topic and a topic of the default's name are two rows of one label."""
    named = chats.join(topics, "topic_id", "left")
    return (
        named.groupBy("name")
        .agg(F.count("*").alias("questions"))
        .select(F.coalesce("name", F.lit(GENERAL_TOPIC)).alias("topic"), "questions")
    )


def top_users(chats: DataFrame, users: DataFrame, n: int = 20) -> DataFrame:
    """The ``n`` users with most questions; equal counts by user id. Counted before the join."""
    counts = chats.filter(F.col("user_id").isNotNull()).groupBy("user_id").agg(F.count("*").alias("questions"))
    return counts.join(users.select("user_id", "username"), "user_id").orderBy(F.desc("questions"), "user_id").limit(n)


def questions_per_user(users: DataFrame, chats: DataFrame) -> DataFrame:
    """Questions of every user, 0 included: the filter on chats belongs to the join."""
    counts = chats.filter(~F.col("is_deleted")).groupBy("user_id").agg(
        F.count("*").alias("questions"), F.max("created_at").alias("last_question")
    )
    return users.join(counts, "user_id", "left").withColumn("questions", F.coalesce("questions", F.lit(0)))


def details(chats: DataFrame, users: DataFrame, topics: DataFrame, limit: int = MAX_DETAIL_ROWS) -> DataFrame:
    """One row per chat with names, newest first; one row beyond ``limit`` tells that more exist."""
    newest = chats.orderBy(F.desc("created_at"), F.desc("id")).limit(limit + 1)
    return newest.join(users.select("user_id", "username", "is_deleted").withColumnRenamed("is_deleted", "gone"), "user_id", "left").join(
        topics, "topic_id", "left"
    ).select(
        "id",
        F.date_format(local(F.col("created_at")), "yyyy-MM-dd HH:mm:ss").alias("asked_at"),
        F.when(F.col("gone"), F.lit("Deleted user")).otherwise(F.coalesce("username", F.lit("Unknown"))).alias("username"),
        F.coalesce("name", F.lit(GENERAL_TOPIC)).alias("topic"),
        "question",
        "latency_ms",
    )


def log_page(
    chats: DataFrame,
    users: DataFrame,
    topics: DataFrame,
    search: str | None = None,
    topic: str | None = None,
    bounds: tuple[Column, Column] | None = None,
    page: int = 1,
    size: int = 20,
    newest: bool = True,
) -> DataFrame:
    """A page of the log. ``search`` is a LIKE pattern without escapes, so % and _ match anything.

    The topic ``General Guidance`` takes chats without a topic too. ``total`` counts all matching rows.
    """
    out = chats.filter(~F.col("is_deleted"))
    if bounds:
        out = out.filter((F.col("created_at") >= bounds[0]) & (F.col("created_at") < bounds[1]))
    if search:
        out = out.filter(F.col("question").ilike(f"%{search}%") | F.col("answer").ilike(f"%{search}%"))
    out = out.join(topics, "topic_id", "left")
    if topic == GENERAL_TOPIC:
        out = out.filter(F.col("name").isNull() | (F.col("name") == topic))
    elif topic:
        out = out.filter(F.col("name") == topic)
    total = out.agg(F.count("*").alias("total"))
    order = [F.desc("created_at"), F.desc("id")] if newest else ["created_at", "id"]
    rows = out.orderBy(*order).offset((page - 1) * size).limit(size)
    named = rows.join(users.select("user_id", "username"), "user_id", "left")
    return named.join(F.broadcast(total)).select(
        "id",
        F.coalesce("username", F.lit("Unknown")).alias("username"),
        F.coalesce("name", F.lit(GENERAL_TOPIC)).alias("topic"),
        "question",
        F.date_format(local(F.col("created_at")), "yyyy-MM-dd HH:mm:ss").alias("asked_at"),
        "total",
        (F.col("total") > page * size).alias("has_next"),
    )


def local_day_bounds(as_of: str, period: str, zone: str = ZONE) -> tuple[Column, Column]:
    """UTC bounds of the local day, Monday week, month or year that holds the UTC time ``as_of``."""
    day = F.to_date(local(F.lit(as_of).cast("timestamp_ntz"), zone))
    start = day if period == "day" else F.trunc(day, period)
    step = {"day": F.date_add(start, 1), "week": F.date_add(start, 7), "month": F.add_months(start, 1), "year": F.add_months(start, 12)}
    utc = lambda d: F.convert_timezone(F.lit(zone), F.lit("UTC"), d.cast("timestamp_ntz"))
    return utc(start), utc(step[period])


def status_counts(documents: DataFrame) -> DataFrame:
    """Documents of each status, all four numbers in one row; deleted ones do not count."""
    live = documents.filter(F.col("status") != "deleted")
    return live.agg(
        *(F.count_if(F.col("status") == s).alias(s) for s in ("ready", "indexing", "failed")), F.count("*").alias("total")
    )


def sort_documents(documents: DataFrame, order: str, locale: str = "vi") -> DataFrame:
    """Documents (file_name, file_size, chunk_count, updated_at, …) in one of six orders, equal ones by id.

    Names are compared as the language ``locale`` does; an unknown order is the newest first.
    """
    name = F.collate("file_name", locale)
    orders = {
        "updated_asc": F.asc("updated_at"), "name_asc": name.asc(), "name_desc": name.desc(),
        "size_desc": F.desc("file_size"), "chunks_desc": F.desc("chunk_count"),
    }
    return documents.orderBy(orders.get(order, F.desc("updated_at")), "id")


def online_users(activity: DataFrame, as_of: str, minutes: int = 5) -> DataFrame:
    """Users whose last activity is at most ``minutes`` before ``as_of``."""
    now = F.lit(as_of).cast("timestamp_ntz")
    last = activity.filter(F.col("created_at") <= now).groupBy("user_id").agg(F.max("created_at").alias("last_active"))
    return last.filter(F.col("last_active") >= now - F.expr(f"interval {int(minutes)} minutes")).select("user_id")


def kpis(users: DataFrame, chats: DataFrame, feedback: DataFrame, documents: DataFrame, as_of: str) -> DataFrame:
    """Head figures as one row: an aggregate for each table, joined."""
    u = users.agg(
        F.count_if(~F.col("is_deleted")).alias("users"), F.count_if(F.col("is_deleted")).alias("deleted_users"),
        F.count_if((F.col("role") == "admin") & ~F.col("is_deleted")).alias("admins"),
    )
    c = chats.filter(~F.col("is_deleted")).agg(F.count("*").alias("questions"))
    f = feedback.filter(~F.col("is_deleted")).agg(
        F.count_if(F.col("rating") == "like").alias("likes"), F.count_if(F.col("rating") == "dislike").alias("dislikes")
    )
    d = documents.filter(F.col("status") != "deleted").agg(F.count("*").alias("documents"))
    o = online_users(chats, as_of).agg(F.count("*").alias("online"))
    return u.join(c).join(f).join(d).join(o)
