"""Exact users online, figures kept batch by batch, restarts, and the progress of a build."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from lanternlake.operators import chunks, reports
from lanternlake.streaming import online, refresh, replay
from lanternlake.streaming.progress import Progress

START = datetime.datetime(2024, 3, 1)


def add(spark, folder, number, rows):
    """A file of events (minutes after the start, user)."""
    data = [(number * 1000 + i, START + datetime.timedelta(minutes=m), u, "click", 1.0, "{}") for i, (m, u) in enumerate(rows)]
    frame = spark.createDataFrame(data, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").toPandas()
    frame.to_parquet(folder / f"events-{number:03d}.parquet", coerce_timestamps="us")


def stretches(rows, span):
    out = {}
    for u in {u for _, u in rows}:
        times = sorted(m for m, v in rows if v == u)
        mine = [[times[0], times[0] + span]]
        for t in times[1:]:
            if t <= mine[-1][1]:
                mine[-1][1] = t + span
            else:
                mine.append([t, t + span])
        out[u] = mine
    return out


def test_online_users_are_exact_with_late_rows(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    rng = random.Random(6)
    rows = [(rng.randint(0, 400), rng.randint(1, 12)) for _ in range(300)]
    rows.sort(key=lambda r: r[0] + rng.randint(0, 50))  # up to 50 minutes behind
    files = [rows[i : i + 60] for i in range(0, 300, 60)] + [[(2000, 99)], [(2001, 99)]]
    for n, part in enumerate(files):
        add(spark, source, n, part)
    root = tmp_path / "out"
    stream = online.online_intervals(replay.events(spark, str(source), 1), 7, "1 hour")
    query = stream.writeStream.outputMode("append").format("parquet").option("path", str(root)).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    query.awaitTermination()
    found = spark.read.schema(online.INTERVAL).parquet(str(root))
    minutes = lambda c: (F.unix_timestamp(c) - F.unix_timestamp(F.lit(START.isoformat(" ")).cast("timestamp"))) / 60
    got = sorted((r[0], r[1], r[2]) for r in found.select("user_id", minutes("start"), minutes("end")).collect())
    assert got == sorted((u, a, b) for u, mine in stretches(rows, 7).items() for a, b in mine)
    for m in (0, 33, 150, 399):
        as_of = str(START + datetime.timedelta(minutes=m))
        batch = spark.createDataFrame([(START + datetime.timedelta(minutes=t), u) for t, u in rows], "created_at timestamp_ntz, user_id long")
        want = {r.user_id for r in reports.online_users(batch, as_of, 7).collect()}
        assert {r.user_id for r in online.online_at(found, as_of).collect()} >= want
        assert {u for u, mine in stretches(rows, 7).items() if any(a <= m <= b for a, b in mine)} == {r.user_id for r in online.online_at(found, as_of).collect()}


def test_stretches_are_built_in_functions(spark, tmp_path):
    add(spark, tmp_path, 0, [(0, 1), (7, 1), (14.001, 1), (3, 2), (900, 9)])
    add(spark, tmp_path, 1, [(901, 9)])
    stream = online.online_intervals(replay.events(spark, str(tmp_path), 1), 7, "1 hour")
    # A state in Python costs calls for every user and batch.
    assert "Python" not in stream._jdf.queryExecution().analyzed().toString()
    query = stream.writeStream.outputMode("append").format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/ck").trigger(availableNow=True).start()
    query.awaitTermination()
    found = spark.read.schema(online.INTERVAL).parquet(f"{tmp_path}/out").select("user_id", *(F.unix_millis(c).alias(c) for c in ("start", "end"))).collect()
    zero = min(r.start for r in found)
    # Exactly the span apart is one stretch, a little more is another one.
    assert sorted((r.user_id, r.start - zero, r.end - zero) for r in found) == [(1, 0, 840_000), (1, 840_060, 1_260_060), (2, 180_000, 600_000)]


def chats(events):
    return events.select(F.col("ts").cast("timestamp_ntz").alias("created_at"), "user_id", F.col("value").alias("latency_ms"))


def day_rows(df):
    return sorted(tuple(r) for r in df.select("bucket", "questions", "users", "avg_latency").collect())


def test_figures_follow_each_batch_and_survive_a_restart(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    rng = random.Random(2)
    parts = [[(rng.randint(0, 6000), rng.randint(1, 9)) for _ in range(40)] for _ in range(4)] + [[(5, 1), (7000, 2)]]
    for n, part in enumerate(parts):
        add(spark, source, n, part)
    stream = lambda: replay.events(spark, str(source), 1)
    root, broken = f"file://{tmp_path}/whole", f"file://{tmp_path}/broken"
    refresh.keep_figures(stream(), root, chats, None).awaitTermination()
    for n in range(len(parts)):
        events = spark.read.schema(replay.EVENTS).parquet(*(str(source / f"events-{i:03d}.parquet") for i in range(n + 1)))
        assert day_rows(refresh.figures(spark, root, n)) == day_rows(reports.timeline(chats(events), "day"))

    # Stopped after the figures of a batch were written and before it was committed, twice; then to the end.
    for at in (1, 3):
        def fail(batch, at=at):
            if batch == at:
                raise RuntimeError("killed")

        query = refresh.keep_figures(stream(), broken, chats, None, fail)
        with pytest.raises(Exception, match="killed"):
            query.awaitTermination()
    refresh.keep_figures(stream(), broken, chats, None).awaitTermination()
    assert day_rows(refresh.figures(spark, broken)) == day_rows(refresh.figures(spark, root))
    # Only days of the last batch were computed in it.
    last = spark.read.parquet(f"{tmp_path}/whole/figures/batch=4")
    assert {r.bucket for r in last.collect()} == {"2024-03-01", "2024-03-06"}


def test_replay_runs_twice_at_once(spark, tmp_path):
    add(spark, tmp_path, 0, [(0, 1), (1, 2), (3000, 1)])
    add(spark, tmp_path, 1, [(2, 3)])
    one, two = replay.replay(spark, str(tmp_path)), replay.replay(spark, str(tmp_path))
    assert sorted(map(tuple, one.collect())) == sorted(map(tuple, two.collect())) == [("2024-03-01", "click", 3), ("2024-03-03", "click", 1)]


def test_progress_of_a_build(spark, tmp_path):
    pages = spark.range(400).select(F.lit("a.pdf").alias("source"), F.col("id").cast("int").alias("page"), F.repeat(F.lit("words of a page. "), 200).alias("content")).repartition(24)
    seen = []
    with Progress(spark, seen.append, steps=2, every=0.02) as progress:
        chunks.chunk_pages(pages).write.parquet(f"{tmp_path}/one")
        progress.step()
        chunks.chunk_pages(pages).groupBy("heading").count().write.parquet(f"{tmp_path}/two")
    assert seen == sorted(set(seen)) and seen[0] == 0.0 and seen[-1] == 1.0 and 0.5 in seen and len(seen) > 4
    failed = []
    with pytest.raises(ZeroDivisionError):
        with Progress(spark, failed.append):
            1 / 0
    assert failed == [0.0]
