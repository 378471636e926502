import hashlib
import json

import pytest
from pyspark.sql import functions as F

from lanternlake.operators import lifecycle, reports
from lanternlake.sources import files, store
from lanternlake.streaming import replay


def test_files(spark, tmp_path):
    for name, data in (("b.PDF", b"%PDF-1"), ("A.pdf", b"%PDF-2"), ("c.txt", b"no")):
        (tmp_path / name).write_bytes(data)
    rows = files.listing(spark, str(tmp_path)).collect()
    assert [(r.file_name, r.file_size, r.checksum) for r in rows] == [(n, 6, hashlib.sha256(d).hexdigest()) for n, d in (("A.pdf", b"%PDF-2"), ("b.PDF", b"%PDF-1"))]
    names = spark.createDataFrame([("a.pdf",), ("x/y.pdf",), (".pdf",), ("b\n.pdf",), ("c.txt",), (None,)], "n string")
    assert [r[0] for r in names.select(files.valid_name(F.col("n"))).collect()] == [True, False, False, False, False, False]


def test_json_and_manifest(spark, tmp_path):
    good, bad, manifest = tmp_path / "good.json", tmp_path / "bad.json", tmp_path / "m.json"
    good.write_text(json.dumps([{"a": 1}, {"a": 2, "b": 3}]))
    bad.write_text("[{")
    manifest.write_text(json.dumps({"documents": [{"source": "a.pdf", "version_rank": 1}], "page_overrides": [{"source": "a.pdf", "page": 2}]}))
    assert [r.a for r in files.json_rows(spark, str(good), "a int").orderBy("a").collect()] == [1, 2]
    assert files.json_rows(spark, str(bad), "a int").count() == 0
    documents, pages = files.manifest(spark, str(manifest))
    assert documents.first().source == "a.pdf" and pages.first().page == 2


def test_image_rules(spark):
    rows = [("", 0.1, True, True), ("phiên bản mới", 0.3, True, True), ("version 01.02.2024", 0.3, True, False), ("version", 0.1, True, False), ("x", 0.9, True, False), (None, 0.9, False, False)]
    df = spark.createDataFrame(rows, "t string, r double, h boolean, want boolean")
    assert all(r[0] == r[1] for r in df.select(files.needs_reading(F.col("t"), F.col("r"), F.col("h")), "want").collect())
    boxes = spark.createDataFrame([([(2.0, 3.0), (-1.0, 5.0)], 12.0), ([(9.0, 9.0)], 12.0), ([], 0.0)], "b array<struct<w:double,h:double>>, a double")
    assert [r[0] for r in boxes.select(files.image_ratio(F.col("b"), F.col("a"))).collect()] == [0.5, 1.0, 0.0]


def test_store_swaps_and_keeps_old_versions(spark, tmp_path):
    root = f"file://{tmp_path}/index"
    assert store.load(spark, root, "t") is None
    first = store.install(root, {"t": spark.range(3), "u": spark.range(1)})
    store.install(root, {"t": spark.range(5), "u": spark.range(2)})
    assert store.load(spark, root, "t").count() == 5
    with pytest.raises(Exception):
        store.install(root, {"t": spark.range(7), "u": spark.range(1).select(F.raise_error(F.lit("stop")).cast("long").alias("id"))})
    assert store.load(spark, root, "t").count() == 5
    store.point(root, first)
    assert store.load(spark, root, "t").count() == 3


def test_stream_drops_late_rows_and_refreshes(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()

    def add(n, hours):
        rows = [(i, h, 1, "click", 1.0, "{}") for i, h in enumerate(hours)]
        df = spark.createDataFrame(rows, "event_id long, h int, user_id long, event_type string, value double, props string")
        df.select("event_id", F.expr("timestamp_ntz'2024-01-01 00:30:00' + make_dt_interval(0, h)").alias("ts"), "user_id", "event_type", "value", "props").toPandas().to_parquet(source / f"events-{n}.parquet", coerce_timestamps="us")

    add(0, [0, 0, 1])
    seen = []
    stream = replay.windowed_counts(replay.events(spark, str(source)), "1 hour", "2 hours")
    query = stream.writeStream.outputMode("update").foreachBatch(lambda df, n: seen.append({(r.window.start.hour, r.events) for r in df.collect()})).option("checkpointLocation", str(tmp_path / "ck")).start()
    query.processAllAvailable()
    add(1, [10])
    query.processAllAvailable()
    add(2, [0, 10])
    query.processAllAvailable()
    query.stop()
    flat = set().union(*seen)
    assert (0, 2) in flat and (10, 2) in flat and (0, 3) not in flat


def test_report_arguments(spark):
    reports.check_report("2024-01-01", "2024-02-01", "week", "all")
    for bad in (("2024-02-01", "2024-01-01", "day", "all"), ("2000-01-01", "2024-01-01", "day", "all"), ("2024-01-01", "2024-01-02", "hour", "all")):
        with pytest.raises(ValueError):
            reports.check_report(*bad)
    t = spark.createDataFrame([("2024-01-07 17:00:00",), ("2024-01-07 16:59:59",), ("2023-01-01 00:00:00",)], "t string").select(F.col("t").cast("timestamp_ntz").alias("t"))
    got = [tuple(r) for r in t.select(*(reports.bucket_label(F.col("t"), g) for g in ("day", "week", "month", "year"))).collect()]
    assert got == [("2024-01-08", "2024-W02", "2024-01", "2024"), ("2024-01-07", "2024-W01", "2024-01", "2024"), ("2023-01-01", "2022-W52", "2023-01", "2023")]


def test_addresses_and_document_orders(spark):
    rows = [(1, " An.Le+1@Example.COM "), (2, "a@example.com.vn"), (3, "a@sub.example.com"), (4, "a b@example.com"), (5, None), (6, "@example.com"), (7, "a@exampleXcom"), (8, "a@example.com\n")]
    got = lifecycle.allowed_addresses(spark.createDataFrame(rows, "user_id int, email string"), ["example.com"]).filter("allowed")
    assert [r.user_id for r in got.collect()] == [1, 8]
    docs = [(1, "Đề thi.pdf", 5, 2, 30), (2, "ảnh.pdf", 7, 1, 10), (3, "Zalo.pdf", 7, 9, 20), (4, "dân.pdf", 1, 2, 40), (5, "an.pdf", 2, 3, 10)]
    df = spark.createDataFrame(docs, "id int, file_name string, file_size int, chunk_count int, updated_at int")
    order = lambda o: [r.id for r in reports.sort_documents(df, o).collect()]
    assert order("name_asc") == [5, 2, 4, 1, 3] and order("name_desc") == [3, 1, 4, 2, 5]
    assert order("size_desc") == [2, 3, 1, 5, 4] and order("chunks_desc") == [3, 5, 1, 4, 2]
    assert order("updated_asc") == [2, 5, 3, 1, 4] and order("any") == [4, 1, 3, 2, 5]
