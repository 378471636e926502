"""Journalled commits, leases, the retention job, and changes between versions."""

import datetime
import threading

import pytest
from pyspark.sql import functions as F

from lanternlake.operators import history, retention
from lanternlake.sources import journal, payload, store
from lanternlake.sources.lease import Lease


def state(spark, roots):
    return [sorted(r[0] for r in t.collect()) if (t := store.load(spark, r, "t")) is not None else None for r in roots]


def test_commit_over_several_stores(spark, tmp_path, monkeypatch):
    a, b, c = (f"file://{tmp_path}/{n}" for n in "abc")
    root = f"file://{tmp_path}/all"
    journal.commit(root, {a: {"t": spark.range(1)}, b: {"t": spark.range(2)}})
    assert state(spark, [a, b, c]) == [[0], [0, 1], None]
    point = store.point

    # The third pointer cannot be moved, and the second cannot be moved back.
    first = store.current(b)
    fails = {(c, "after"), (b, "before")}

    def broken(place, version):
        if place == c and version is not None and (c, "after") in fails or place == b and version == first and (b, "before") in fails:
            raise OSError(f"no {place}")
        point(place, version)

    monkeypatch.setattr(store, "point", broken)
    with pytest.raises(journal.RollbackFailed) as error:
        journal.commit(root, {a: {"t": spark.range(5)}, b: {"t": spark.range(6)}, c: {"t": spark.range(7)}})
    assert len(error.value.exceptions) == 2 and b in str(error.value)
    # Every other step of the rollback ran.
    assert state(spark, [a, b, c]) == [[0], list(range(6)), None]
    fails.clear()
    assert journal.recover(root) == 1
    assert state(spark, [a, b, c]) == [[0], [0, 1], None]
    assert journal.recover(root) == 0
    # A failure that can be taken back leaves nothing behind.
    fails.add((c, "after"))
    with pytest.raises(OSError):
        journal.commit(root, {a: {"t": spark.range(5)}, c: {"t": spark.range(7)}})
    assert state(spark, [a, b, c]) == [[0], [0, 1], None] and journal.recover(root) == 0
    # So does a table that cannot be written: no store has changed yet.
    with pytest.raises(Exception):
        journal.commit(root, {a: {"t": spark.range(5)}, b: {"t": spark.range(1).select(F.raise_error(F.lit("stop")).cast("long").alias("id"))}})
    assert state(spark, [a, b, c]) == [[0], [0, 1], None]


def test_all_rollback_steps_run():
    ran = []

    def bad(name):
        ran.append(name)
        raise ValueError(name)

    with pytest.raises(journal.RollbackFailed) as error:
        journal.run_all([("one", lambda: bad("one")), ("two", lambda: ran.append("two")), ("three", lambda: bad("three"))])
    assert ran == ["one", "two", "three"] and "one, three" in str(error.value) and len(error.value.exceptions) == 2


def test_leases(tmp_path):
    now = [100.0]
    make = lambda: Lease(f"file://{tmp_path}", "job", 10, lambda: now[0])
    one, two = make(), make()
    assert one.take() and not two.take() and one.mine() and not two.mine()
    one.release()
    assert two.take() and not one.take()
    now[0] += 11
    assert not two.mine() and one.take() and one.mine()
    two.release()  # no longer two's to release
    assert one.mine()
    # Of many contenders for an expired lease one wins.
    now[0] += 11
    won, all_ = [], [make() for _ in range(12)]
    threads = [threading.Thread(target=lambda x=x: won.append(x.take())) for x in all_]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert sum(x.mine() for x in all_) <= 1 and sum(won) <= 1


def tables(spark):
    day = lambda n: datetime.datetime(2024, 1, n)
    chats = [(1, 1, "s1", True, "b1", day(1)), (2, 1, "s1", False, None, None), (3, 2, "s2", True, "b1", day(1)), (4, 3, "s3", True, "b2", day(30))]
    sessions = [("s1", False, None, None), ("s2", False, None, None), ("s3", True, "b2", day(30)), ("s4", True, "b3", day(2))]
    users = [(1, "u1", "e1", False, None, None), (2, "u2", "e2", True, day(1), None)]
    return {
        "chats": spark.createDataFrame(chats, "id long, user_id long, session_id string, is_deleted boolean, batch_id string, deleted_at timestamp_ntz"),
        "sessions": spark.createDataFrame(sessions, "session_id string, is_deleted boolean, batch_id string, deleted_at timestamp_ntz"),
        "users": spark.createDataFrame(users, "user_id long, username string, email string, is_deleted boolean, deleted_at timestamp_ntz, purged_at timestamp_ntz"),
    }


def shown(spark, root):
    one = lambda n, c: sorted(str(r[0]) for r in store.load(spark, root, n).select(c).collect())
    return one("chats", "id"), one("sessions", "session_id"), one("users", "username")


PURGED = (["2", "4"], ["s1", "s3"], ["deleted_2", "u1"])


def test_retention_is_taken_up_again(spark, tmp_path):
    root = f"file://{tmp_path}/r"
    store.install(root, tables(spark))

    def stop(step):
        if step == "users":
            raise RuntimeError("killed")

    with pytest.raises(RuntimeError):
        retention.run(spark, root, "2024-02-10 00:00:00", before_step=stop)
    assert shown(spark, root) == (PURGED[0], PURGED[1], ["u1", "u2"])
    assert retention.run(spark, root, "2024-02-10 00:00:00") == ["users"]
    assert shown(spark, root) == PURGED
    assert retention.run(spark, root, "2024-02-10 00:00:00") == []


def test_two_runs_at_once_purge_once(spark, tmp_path):
    root = f"file://{tmp_path}/r"
    store.install(root, tables(spark))
    did = []
    threads = [threading.Thread(target=lambda: did.append(retention.run(spark, root, "2024-02-10 00:00:00"))) for _ in range(3)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    steps = [x for run in did for x in run]
    assert sorted(steps) == ["trash", "users"]
    assert shown(spark, root) == PURGED


def test_changes_of_every_type(spark):
    schema = "k long, a string, n double, l array<int>, m struct<x:int>, b binary, t timestamp_ntz"
    t = datetime.datetime(2024, 5, 6, 7, 8, 9)
    old = [(1, "x", 1.5, [1, None], (1,), b"\x00", t), (2, None, None, None, None, None, None), (3, "", 0.1, [], (None,), b"", t), (4, "gone", 2.0, [4], (4,), b"4", t)]
    new = [(1, "y", 1.5, [1], (1,), b"\x01", t), (2, "", None, None, None, None, None), (3, None, 0.2, None, (2,), None, None), (5, None, None, None, None, None, None)]
    a, b = (spark.createDataFrame(r, schema) for r in (old, new))
    edits = history.changes(a, b, ["k"])
    got = {(r.k, r.change, r.field) for r in edits.collect()}
    assert {x for x in got if x[0] in (1, 2, 5)} == {(1, "changed", "a"), (1, "changed", "l"), (1, "changed", "b"), (2, "changed", "a"), (5, "added", None)}
    assert len([x for x in got if x[0] == 3]) == 6 and len([x for x in got if x[1] == "removed"]) == 6
    back, conflicts = history.taken_back(b, edits, ["k"])
    assert sorted(map(tuple, back.collect()), key=str) == sorted(map(tuple, a.collect()), key=str) and conflicts.count() == 0
    # A field that was changed again stays, and says so; others go back.
    later = b.withColumn("a", F.when(F.col("k") == 1, "z").otherwise(F.col("a")))
    back, conflicts = history.taken_back(later, edits, ["k"], ["a", "b"])
    rows = {r.k: r for r in back.collect()}
    assert rows[1].a == "z" and rows[1].b == b"\x00" and rows[1].l == [1] and rows[2].a is None and set(rows) == {1, 2, 3, 5}
    assert [tuple(r) for r in conflicts.collect()] == [(1, "a", "x", "y", "z")]


def test_payloads_of_any_depth(spark):
    deep = '["in the deep", 0.7]'
    for _ in range(9):
        deep = '{"x": [' + deep + ', 3]}'
    rows = [
        (1, '{"rec_texts": [" one ", "two", "", 5], "rec_scores": [0.9, 0.1], "more": {"rec_texts": ["three"]}}'),
        (2, '[["pair", 0.8], ["low", 0.2], ["not", "pair"], ["a", 1, 2], null, true]'), (3, deep), (4, "no json {"), (5, None), (6, '"text"'), (7, "[]"),
    ]
    got = payload.texts(spark.createDataFrame(rows, "id int, payload string"), 0.65).orderBy("id", "path").collect()
    assert [(r.id, r.text, r.score) for r in got] == [(1, "one", 0.9), (1, "5", 1.0), (1, "three", 1.0), (2, "pair", 0.8), (3, "in the deep", 0.7)]
