import gzip
import hashlib
import io
import json
import zlib

from pyspark.sql import functions as F

from lanternlake.llm import warc
from lanternlake.llm.shared import shared_dir


def rows():
    big = "é<p>" + "x" * 1200
    out = [(i, f"http://h/{i}", big if i % 3 else f"page {i} " + "y" * i * 40) for i in range(40)]
    out += [(100, None, None), (101, "http://a\r\nb: c", ""), (None, "u", big), (None, "u", "only " * 300), (102, "u", "short"), (103, "u", "short")]
    return out + [(50, "u", "twice" * 400), (50, "u", "twice" * 400), (60, "u", "\r\n\r\nWARC/1.1\r\nContent-Length: 3\r\n\r\n" * 50)]


def brute(data):
    payloads = [(i, (h or "").encode()) for i, _, h in data]
    first = {}
    for i, p in payloads:
        if len(p) >= 1000 and i is not None:
            first[p] = max(first.get(p, i), i)
    out = []
    for i, p in payloads:
        f = first.get(p)
        repeated = sum(q == p for _, q in payloads) > 1
        kind = "revisit" if f is not None and repeated and i != f else "response"
        out.append((i, len(p), hashlib.sha1(p).hexdigest(), kind, f if kind == "revisit" else None))
    return sorted(map(str, out))


def test_round_trip(spark):
    df = spark.createDataFrame(rows(), "page_id long, url string, html string").withColumn("payload", F.lit("clash"))
    assert sorted(str(tuple(r)) for r in warc.op3(df.repartition(3)).collect()) == brute(rows())
    assert warc.op3(df.limit(0)).count() == 0


def test_files(spark):
    df = spark.createDataFrame(rows(), "page_id long, url string, html string").coalesce(2)
    folder = shared_dir(spark) + "/warc-test"
    listing = warc.write_monolithic(warc.record_types(df), folder + "/one", roll=20_000)
    archives = warc.normalise(listing, folder + "/many")
    assert listing.count() > 2 and archives.agg(F.sum("records")).first()[0] == len(rows())
    records = []
    for (path,) in archives.select("path").collect():
        cutter = warc.RecordCutter()
        records += [warc.parse_record(r)[0] for piece in warc.inflate(open(path, "rb")) for r in cutter.feed(piece)]
    responses = {r["warc-record-id"]: r for r in records if r["warc-type"] == "response"}
    revisits = [r for r in records if r["warc-type"] == "revisit"]
    assert len(revisits) > 20
    for r in revisits:  # every reference is the id of a response with that page and payload
        other = responses[r["warc-refers-to"]]
        assert (other["warc-page-id"], other["warc-payload-digest"]) == (r["warc-refers-to-page-id"], r["warc-payload-digest"])
    whole = {p.rsplit("/", 1)[1]: gzip.open(p).read() for (p,) in listing.select("path").collect()}
    for (path,) in archives.select("path").collect():
        raw = open(path, "rb").read()
        entries = [json.loads(x) for x in open(path + ".idx")]
        members = [zlib.decompress(raw[e["offset"] : e["offset"] + e["length"]], 31) for e in entries]
        assert sum(e["length"] for e in entries) == len(raw)
        assert b"".join(members) == whole[path.rsplit("/", 1)[1].split("-", 1)[1]]
        assert all(m.startswith(b"WARC/1.1\r\n") and len(m) == e["bytes"] for m, e in zip(members, entries))


def test_inflate_reads_members_and_single_streams():
    data = b"".join(warc.format_record(i, "u", b"p" * i, "00" * 20, "response", None) for i in range(30))
    joined = b"".join(gzip.compress(data[k : k + 777]) for k in range(0, len(data), 777))
    for stream in (gzip.compress(data), joined):
        cutter = warc.RecordCutter()
        cut = [r for piece in warc.inflate(io.BytesIO(stream), 100) for r in cutter.feed(piece)]
        assert b"".join(cut) == data and len(cut) == 30 and not cutter.held


def test_a_very_long_payload(spark):
    big = "".join(f"<p>{i}</p>" for i in range(900_000))
    df = spark.createDataFrame([(1, "u", big), (2, "v", big), (3, "w", "x")], "page_id long, url string, html string")
    got = sorted(str(tuple(r)) for r in warc.op3(df).collect())
    assert got == brute([(1, "u", big), (2, "v", big), (3, "w", "x")])
