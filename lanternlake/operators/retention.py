"""The retention job: expired trash and users are purged by one run at a time, which others can take up again."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import store
from ..sources.lease import Lease
from . import lifecycle

LEASE_SECONDS = 3_600


def purge_batches(chats: DataFrame, sessions: DataFrame, due: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both tables without the chats of the batches ``due`` (batch_id), and without sessions that no chat is left of.

    Sessions go that are in such a batch themselves or own a chat of one, as with ``lifecycle.hard_delete``
    for a single batch.
    """
    left = chats.join(due, "batch_id", "left_anti").select(*chats.columns)
    touched = chats.join(due, "batch_id", "left_semi").select("session_id").union(sessions.join(due, "batch_id", "left_semi").select("session_id"))
    orphans = touched.distinct().join(left.select("session_id"), "session_id", "left_anti")
    return left, sessions.join(orphans, "session_id", "left_anti").select(*sessions.columns)


def due_batches(chats: DataFrame, sessions: DataFrame, as_of: str, days: int = lifecycle.RETENTION_DAYS) -> DataFrame:
    """Deletion batches that are old enough."""
    old = lifecycle.expired(as_of, days)
    return lifecycle.batch_ids(chats.filter(old), sessions.filter(old))


def run(spark: SparkSession, root: str, as_of: str, days: int = lifecycle.RETENTION_DAYS, seconds: float = LEASE_SECONDS, before_step: Callable[[str], None] | None = None) -> list[str]:
    """Purge the tables chats, sessions and users of the store ``root``; returns the steps that this run did.

    Without the lease nothing is done. The state of the store names the purge and its finished steps, and is part of
    the version that a step installs, so a run that ended early is taken up at its next step, and no step is
    done twice for one ``as_of``. A run that has lost its lease installs nothing more.
    """
    lease = Lease(root, "retention", seconds)
    if not lease.take():
        return []
    try:
        done = []
        for step in ("trash", "users"):
            version = store.current(root)
            tables = {name: store.load(spark, root, name, version) for name in ("chats", "sessions", "users", "purges")}
            finished = [(r.as_of, r.step) for r in tables["purges"].collect()] if tables["purges"] is not None else []
            if (as_of, step) in finished:
                continue
            if before_step:
                before_step(step)
            if step == "trash":
                due = due_batches(tables["chats"], tables["sessions"], as_of, days)
                tables["chats"], tables["sessions"] = purge_batches(tables["chats"], tables["sessions"], due)
            else:
                tables["users"] = lifecycle.anonymise(tables["users"], as_of, days)
            tables["purges"] = spark.createDataFrame([*finished, (as_of, step)], "as_of string, step string")
            new = store.write_version(root, tables)
            if not lease.mine() or store.current(root) != version:
                return done
            store.point(root, new)
            done.append(step)
        return done
    finally:
        lease.release()
