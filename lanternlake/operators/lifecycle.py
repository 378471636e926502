"""Lifecycle changes as functions from old tables to new ones."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RETENTION_DAYS = 30


def delete_preview(chats: DataFrame, chosen: Column) -> DataFrame:
    """Live chats that a deletion would take, and their distinct sessions."""
    return chats.filter(~F.col("is_deleted") & chosen).agg(
        F.count("*").alias("logs"), F.countDistinct("session_id").alias("sessions")
    )


def bulk_delete(chats: DataFrame, chosen: Column, batch: str, by: int, as_of: str) -> DataFrame:
    """All chats, the chosen live ones marked as one deletion batch."""
    take = ~F.col("is_deleted") & F.coalesce(chosen, F.lit(False))
    return chats.withColumns(
        {
            "is_deleted": F.col("is_deleted") | take,
            "batch_id": F.when(take, F.lit(batch)).otherwise(F.col("batch_id")),
            "deleted_by": F.when(take, F.lit(by)).otherwise(F.col("deleted_by")),
            "deleted_at": F.when(take, F.lit(as_of).cast("timestamp_ntz")).otherwise(F.col("deleted_at")),
        }
    )


def empty_sessions(sessions: DataFrame, chats: DataFrame) -> DataFrame:
    """Live sessions without a live chat."""
    live = chats.filter(~F.col("is_deleted")).select("session_id")
    return sessions.filter(~F.col("is_deleted")).join(live, "session_id", "left_anti")


def cascade(sessions: DataFrame, chats: DataFrame, batch: str, as_of: str) -> DataFrame:
    """All sessions, those that a deletion left empty marked with its batch."""
    gone = empty_sessions(sessions, chats).select("session_id", F.lit(True).alias("gone"))
    return sessions.join(gone, "session_id", "left").withColumns(
        {
            "is_deleted": F.col("is_deleted") | F.coalesce("gone", F.lit(False)),
            "batch_id": F.when(F.col("gone"), F.lit(batch)).otherwise(F.col("batch_id")),
            "deleted_at": F.when(F.col("gone"), F.lit(as_of).cast("timestamp_ntz")).otherwise(F.col("deleted_at")),
        }
    ).drop("gone")


def batch_ids(chats: DataFrame, sessions: DataFrame) -> DataFrame:
    """Distinct deletion batches of chats and of sessions."""
    of = lambda t: t.filter(F.col("is_deleted") & F.col("batch_id").isNotNull()).select("batch_id").distinct()
    return of(chats).union(of(sessions)).distinct()


def trash_batches(chats: DataFrame, sessions: DataFrame) -> DataFrame:
    """One row per batch: time, chats, sessions, preview of the earliest question, and who deleted.

    Chats and sessions are one union and one aggregation, not a query for each batch.
    """
    one = chats.filter(F.col("is_deleted") & F.col("batch_id").isNotNull()).select(
        "batch_id", "deleted_at", "session_id", F.lit(1).alias("log"), "question", "created_at", "id",
        (F.col("deleted_by") == F.col("user_id")).alias("own"),
    )
    two = sessions.filter(F.col("is_deleted") & F.col("batch_id").isNotNull()).select(
        "batch_id", "deleted_at", "session_id", F.lit(0).alias("log"), F.lit(None).cast("string").alias("question"),
        F.lit(None).cast("timestamp_ntz").alias("created_at"), F.lit(None).cast("long").alias("id"), F.lit(None).cast("boolean").alias("own"),
    )
    first = F.min(F.when(F.col("log") == 1, F.struct("created_at", "id", "question")))
    source = (
        F.when(F.bool_and("own"), "self_service").when(F.count("own") > 0, "admin").otherwise("unknown")
    )
    return one.union(two).groupBy("batch_id").agg(
        F.max("deleted_at").alias("deleted_at"),
        F.sum("log").alias("logs"),
        F.countDistinct("session_id").alias("sessions"),
        F.substring(first["question"], 1, 120).alias("preview"),
        source.alias("deletion_source"),
    )


def trash_users(users: DataFrame) -> DataFrame:
    """Deleted users that are not purged, with the name of who deleted them."""
    actors = users.select(F.col("user_id").alias("deleted_by"), F.col("username").alias("actor"))
    gone = users.filter(F.col("is_deleted") & F.col("purged_at").isNull())
    source = F.when(F.col("deleted_by").isNull(), "unknown").when(F.col("deleted_by") == F.col("user_id"), "self_service").otherwise("admin")
    return gone.join(actors, "deleted_by", "left").select("user_id", "username", "deleted_at", F.coalesce("actor", F.lit("Unknown")).alias("actor"), source.alias("deletion_source"))


def restore(chats: DataFrame, sessions: DataFrame, batch: str) -> tuple[DataFrame, DataFrame]:
    """Both tables with a batch restored, and with it the deleted sessions that own its chats."""
    mine = F.coalesce(F.col("batch_id") == batch, F.lit(False))
    owners = chats.filter(mine).select("session_id").distinct().withColumn("owner", F.lit(True))
    new_chats = chats.withColumns({"is_deleted": F.col("is_deleted") & ~mine, "batch_id": F.when(~mine, F.col("batch_id"))})
    joined = sessions.join(owners, "session_id", "left")
    back = mine | F.coalesce("owner", F.lit(False))
    new_sessions = joined.withColumns({"is_deleted": F.col("is_deleted") & ~back, "batch_id": F.when(~back, F.col("batch_id"))}).drop("owner")
    return new_chats, new_sessions


def hard_delete(chats: DataFrame, sessions: DataFrame, batch: str) -> tuple[DataFrame, DataFrame]:
    """Both tables without the chats of a batch, and without its sessions and owners that no chat is left of."""
    mine = F.coalesce(F.col("batch_id") == batch, F.lit(False))
    left = chats.filter(~mine)
    touched = chats.filter(mine).select("session_id").union(sessions.filter(mine).select("session_id")).distinct()
    orphans = touched.join(left.select("session_id"), "session_id", "left_anti")
    return left, sessions.join(orphans, "session_id", "left_anti")


def propagate(chats: DataFrame, sessions: DataFrame) -> DataFrame:
    """All chats; live ones of a deleted session take its deletion over, present values stay."""
    gone = sessions.filter("is_deleted").select("session_id", F.col("batch_id").alias("b"), F.col("deleted_at").alias("t"), F.lit(True).alias("gone"))
    joined = chats.join(gone, "session_id", "left")
    return joined.withColumns(
        {
            "is_deleted": F.col("is_deleted") | F.coalesce("gone", F.lit(False)),
            "batch_id": F.coalesce("batch_id", "b"),
            "deleted_at": F.coalesce("deleted_at", "t"),
        }
    ).drop("gone", "b", "t")


def expired(as_of: str, days: int = RETENTION_DAYS) -> Column:
    """Deleted at least ``days`` before ``as_of``."""
    return F.col("deleted_at") <= F.lit(as_of).cast("timestamp_ntz") - F.expr(f"interval {int(days)} days")


def anonymise(users: DataFrame, as_of: str, days: int = RETENTION_DAYS) -> DataFrame:
    """All users, expired deleted ones without personal values and marked as purged."""
    due = F.coalesce(F.col("is_deleted") & F.col("purged_at").isNull() & expired(as_of, days), F.lit(False))
    alias = F.concat(F.lit("deleted_"), F.lower(F.hex("user_id")))
    return users.withColumns(
        {
            "username": F.when(due, alias).otherwise(F.col("username")),
            "email": F.when(due, F.concat(alias, F.lit("@deleted.invalid"))).otherwise(F.col("email")),
            "purged_at": F.when(due, F.lit(as_of).cast("timestamp_ntz")).otherwise(F.col("purged_at")),
        }
    )


def duplicate_identities(users: DataFrame, column: str) -> DataFrame:
    """Values that more than one user has, without case and outer blanks."""
    key = F.lower(stripped(column))
    return users.groupBy(key.alias("identity")).agg(F.count("*").alias("n")).filter("n > 1")


def stripped(text: str) -> Column:
    """A column without white space of any kind around it."""
    return F.regexp_replace(text, r"(?U)\A\s+|\s+\z", "")


def normalise_identities(users: DataFrame) -> DataFrame:
    """All users with trimmed names and trimmed lower-case addresses, and whether that changed anything."""
    name, mail = stripped("username"), F.lower(stripped("email"))
    changed = ~name.eqNullSafe(F.col("username")) | ~mail.eqNullSafe(F.col("email"))
    return users.select("user_id", name.alias("username"), mail.alias("email"), changed.alias("changed"))


def allowed_addresses(users: DataFrame, domains: list[str]) -> DataFrame:
    """(user_id, allowed): whether the normalised address is of one of ``domains``; null addresses are not."""
    hosts = "|".join(re.escape(d) for d in domains)
    allowed = F.lower(stripped("email")).rlike(rf"\A[a-z0-9._%+-]+@(?:{hosts})\z")
    return users.select("user_id", F.coalesce(allowed, F.lit(False)).alias("allowed"))


def case_collisions(new: DataFrame, existing: DataFrame) -> DataFrame:
    """New file names that differ from an existing one only by case, with the first such."""
    old = existing.groupBy(F.lower("file_name").alias("key")).agg(F.min_by("file_name", "id").alias("existing_name"))
    return new.select("file_name", F.lower("file_name").alias("key")).join(old, "key").filter("file_name <> existing_name").select("file_name", "existing_name")


def unindexed(required: DataFrame, chunks: DataFrame) -> DataFrame:
    """Required sources without any chunk, names compared without case."""
    have = chunks.select(F.lower("source").alias("key")).distinct()
    return required.withColumn("key", F.lower("source")).join(have, "key", "left_anti").drop("key")


def sync_documents(listing: DataFrame, stored: DataFrame, chunks: DataFrame, refresh: bool = False) -> DataFrame:
    """Upsert of a directory listing (file_name, file_size, checksum) into stored rows.

    Rows without a file stay untouched. Listed files take size and checksum from the listing where they
    are new or ``refresh`` is set, and are ready exactly if they have chunks.
    """
    counts = chunks.groupBy(F.col("source").alias("file_name")).agg(F.count("*").alias("found"))
    new = listing.join(counts, "file_name", "left").select("file_name", F.col("file_size").alias("new_size"), F.col("checksum").alias("new_checksum"), F.coalesce("found", F.lit(0)).alias("found"), F.lit(True).alias("listed"))
    merged = stored.join(new, "file_name", "full_outer")
    take = lambda old, fresh: F.coalesce(fresh, old) if refresh else F.coalesce(old, fresh)
    return merged.select(
        "file_name",
        take(F.col("file_size"), F.col("new_size")).alias("file_size"),
        take(F.col("checksum"), F.col("new_checksum")).alias("checksum"),
        F.when(F.col("listed"), F.when(F.col("found") > 0, "ready").otherwise("failed")).otherwise(F.col("status")).alias("status"),
        F.when(F.col("listed"), F.col("found")).otherwise(F.col("chunk_count")).cast("long").alias("chunk_count"),
    )


def latest_feedback(events: DataFrame) -> DataFrame:
    """One row per chat: the last rating wins."""
    return events.groupBy("chat_id").agg(F.max(F.struct("created_at", "event_id", "rating")).alias("last")).select("chat_id", "last.rating", "last.event_id")


def resolve_feedback(feedback: DataFrame, actions: DataFrame) -> DataFrame:
    """All feedback after actions (chat_id, is_resolved, by, at): the last action on a live row holds.

    Resolving notes who and when; reopening clears both. Deleted rows and rows without an action stay.
    """
    last = actions.groupBy("chat_id").agg(F.max(F.struct("at", "is_resolved", "by")).alias("last"))
    acts = F.col("last").isNotNull() & ~F.col("is_deleted")
    done = F.col("last.is_resolved")
    new = {"is_resolved": done, "resolved_by": F.when(done, F.col("last.by")), "resolved_at": F.when(done, F.col("last.at"))}
    out = feedback.join(last, "chat_id", "left")
    return out.select(*(F.when(acts, new[c]).otherwise(F.col(c)).alias(c) if c in new else F.col(c) for c in feedback.columns))


def delete_feedback(feedback: DataFrame, ids: DataFrame) -> DataFrame:
    """All feedback, with the rows of chats in ``ids`` (chat_id) marked as deleted; nothing is removed."""
    gone = ids.select("chat_id", F.lit(True).alias("_gone")).distinct()
    out = feedback.join(gone, "chat_id", "left").withColumn("is_deleted", F.col("is_deleted") | F.coalesce("_gone", F.lit(False)))
    return out.select(*feedback.columns)


def search_feedback(feedback: DataFrame, chats: DataFrame, users: DataFrame, pattern: str | None = None, rating: str = "all", resolved: str = "all") -> DataFrame:
    """Live feedback with its question, author and resolver; ``pattern`` is tried on five columns."""
    f = feedback.filter(~F.col("is_deleted"))
    if rating != "all":
        f = f.filter(F.col("rating") == rating)
    if resolved != "all":
        f = f.filter(F.col("is_resolved") == (resolved == "yes"))
    authors = users.select("user_id", F.col("username").alias("author"), F.col("email").alias("author_email"))
    resolvers = users.select(F.col("user_id").alias("resolved_by"), F.col("username").alias("resolver"))
    c = chats.select(F.col("id").alias("chat_id"), "user_id", "question", "answer")
    out = f.join(c, "chat_id", "left").join(authors, "user_id", "left").join(resolvers, "resolved_by", "left")
    if pattern:
        hit = F.lit(False)
        for column in ("comment", "question", "answer", "author", "author_email"):
            hit = hit | F.coalesce(F.col(column).ilike(f"%{pattern}%"), F.lit(False))
        out = out.filter(hit)
    return out.select("chat_id", "rating", "comment", "question", "author", "resolver")


def session_history(chats: DataFrame) -> DataFrame:
    """Messages of sessions: each live chat is a question and, where there is one, an answer."""
    turns = F.explode(
        F.array(
            F.struct(F.lit(0).alias("n"), F.lit("user").alias("role"), F.col("question").alias("content")),
            F.struct(F.lit(1).alias("n"), F.lit("assistant").alias("role"), F.col("answer").alias("content")),
        )
    )
    rows = chats.filter(~F.col("is_deleted")).select("session_id", "id", "created_at", turns.alias("t"))
    return rows.filter((F.col("t.n") == 0) | (F.coalesce("t.content", F.lit("")) != "")).select("session_id", "id", "created_at", "t.n", "t.role", "t.content")


def is_last_admin(users: DataFrame, user_id: int) -> DataFrame:
    """Whether no other live admin remains without a user."""
    others = users.filter((F.col("role") == "admin") & ~F.col("is_deleted") & (F.col("user_id") != user_id))
    return others.agg((F.count("*") == 0).alias("last_admin"))


def activity(rows: DataFrame, kind: str, *columns: str) -> DataFrame:
    """Activity rows with the given columns as JSON."""
    return rows.select("user_id", F.lit(kind).alias("activity_type"), F.to_json(F.struct(*columns)).alias("metadata"))


def names_differ(names: DataFrame, column: str = "file_name") -> DataFrame:
    """Whether all names of a batch differ without case."""
    return names.agg((F.count(column) == F.countDistinct(F.lower(column))).alias("unique"))
