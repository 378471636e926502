"""WARC archives: writing, the monolithic-gzip normaliser with its offset index, and reading back."""

from __future__ import annotations

import base64
import hashlib
import json
import urllib.parse
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import map_texts, materialise, shared_dir

#: Payloads below this size are never revisits.
MIN_REVISIT = 1000
#: A new archive begins after so many uncompressed bytes.
ARCHIVE_BYTES = 16 << 20
#: The tables have no time of capture.
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP_HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"


def record_types(pages: DataFrame, min_bytes: int = MIN_REVISIT) -> DataFrame:
    """page_id, url, payload (binary), payload_bytes, payload_digest (hex), record_type, refers_to.

    Of equal payloads of at least ``min_bytes`` the record with the largest page_id is the response and
    the others revisit it. Equal page_ids among those are responses alike; a null page_id never is the
    largest unless all are null, and then all are responses. A null html is an empty payload.
    """
    payload = F.coalesce("html", F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", payload.alias("payload"))
    rows = rows.withColumn("payload_digest", F.sha1("payload")).withColumn(
        "payload_bytes", F.octet_length("payload").cast("long")
    )
    repeated = (
        rows.filter(F.col("payload_bytes") >= min_bytes)
        .groupBy("payload_digest", "payload_bytes")
        .agg(F.max("page_id").alias("_first"), F.count("*").alias("_n"))
        .filter("_n > 1 and _first is not null")
        .drop("_n")
    )
    # Written first: the few digests that repeat are then broadcast if small, without moving any payload.
    repeated = materialise(repeated, "warc-repeated")
    revisit = F.col("_first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("_first"))
    return rows.join(repeated, ["payload_digest", "payload_bytes"], "left").select(
        "page_id", "url", "payload", "payload_bytes", "payload_digest",
        F.when(revisit, "revisit").otherwise("response").alias("record_type"),
        F.when(revisit, F.col("_first")).alias("refers_to"),
    )


def record_id(page_id, digest: str, *more: str) -> str:
    """Id of a record. That of a response that others may refer to follows from its page and digest alone."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, '|'.join(('' if page_id is None else str(page_id), digest, *more)))}>"


def format_record(page_id, url, payload: bytes, digest: str, kind: str, refers_to) -> bytes:
    """One uncompressed WARC/1.1 record with its HTTP head; a revisit holds the head only and names the response's record."""
    referable = kind == "response" and len(payload) >= MIN_REVISIT
    block = HTTP_HEAD if kind == "revisit" else HTTP_HEAD + payload
    fields = [
        ("WARC-Type", kind),
        ("WARC-Record-ID", record_id(page_id, digest) if referable else record_id(page_id, digest, kind, url or "")),
        ("WARC-Date", DATE),
        ("WARC-Target-URI", urllib.parse.quote(url or "", safe="%/:?#[]@!$&'()*+,;=~")),
        ("WARC-Payload-Digest", "sha1:" + base64.b32encode(bytes.fromhex(digest)).decode()),
        ("WARC-Page-ID", "" if page_id is None else str(page_id)),
        ("WARC-Payload-Length", str(len(payload))),
    ]
    if kind == "revisit":
        fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", record_id(refers_to, digest)), ("WARC-Refers-To-Page-ID", str(refers_to))]
    fields += [("Content-Type", "application/http;msgtype=response"), ("Content-Length", str(len(block)))]
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n"
    return head.encode() + block + b"\r\n\r\n"


def parse_record(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields (names lower-cased) and content block of one record."""
    end = raw.index(b"\r\n\r\n")
    lines = raw[:end].decode().split("\r\n")
    fields = {k.strip().lower(): v.strip() for k, v in (line.split(":", 1) for line in lines[1:])}
    return fields, raw[end + 4 : end + 4 + int(fields["content-length"])]


class RecordCutter:
    """Cuts an uncompressed WARC stream, fed in pieces, into whole records."""

    def __init__(self):
        self.held = bytearray()

    def feed(self, piece: bytes) -> Iterator[bytes]:
        self.held += piece
        at = 0
        while (end := self.held.find(b"\r\n\r\n", at)) >= 0:
            head = bytes(self.held[at:end]).lower()
            mark = head.index(b"\r\ncontent-length:") + 17
            stop = end + 4 + int(head[mark:].split(b"\r\n", 1)[0]) + 4
            if stop > len(self.held):
                break
            yield bytes(self.held[at:stop])
            at = stop
        del self.held[:at]


def inflate(stream, piece: int = 1 << 20) -> Iterator[bytes]:
    """Uncompressed pieces of a gzip file of one or many members, read once."""
    engine = zlib.decompressobj(31)
    while data := stream.read(piece):
        while data:
            if out := engine.decompress(data):
                yield out
            data = engine.unused_data
            if engine.eof:
                engine = zlib.decompressobj(31)


def _filesystem(folder: str):
    return pafs.FileSystem.from_uri(folder)


def _write_monolithic(folder: str, roll: int):
    """Each archive is one gzip stream over all its records. Its name holds the task attempt."""

    def run(batches):
        fs, root = _filesystem(folder)
        attempt, number, stream, engine, size, count = TaskContext.get().taskAttemptId(), 0, None, None, 0, 0
        for batch in batches:
            for row in zip(*(batch.column(c) for c in ("page_id", "url", "payload", "payload_digest", "record_type", "refers_to"))):
                raw = format_record(*(v.as_py() for v in row))
                if stream is None:
                    path = f"{root}/{attempt:08d}-{number:05d}.warc.gz"
                    stream, engine = fs.open_output_stream(path, compression=None), zlib.compressobj(1, zlib.DEFLATED, 31)
                stream.write(engine.compress(raw))
                size, count = size + len(raw), count + 1
                if size >= roll:
                    stream.write(engine.flush())
                    stream.close()
                    yield pa.RecordBatch.from_pydict({"path": [path], "records": [count]})
                    stream, size, count, number = None, 0, 0, number + 1
        if stream is not None:
            stream.write(engine.flush())
            stream.close()
            yield pa.RecordBatch.from_pydict({"path": [path], "records": [count]})

    return run


def _normalise(folder: str):
    def run(batches):
        fs, root = _filesystem(folder)
        attempt = TaskContext.get().taskAttemptId()
        for batch in batches:
            for path in batch.column(0).to_pylist():
                name = f"{root}/{attempt:08d}-{path.rsplit('/', 1)[1]}"
                entries, offset, cutter = [], 0, RecordCutter()
                with fs.open_input_stream(path, compression=None) as source, fs.open_output_stream(name, compression=None) as out:
                    for piece in inflate(source):
                        for raw in cutter.feed(piece):
                            engine = zlib.compressobj(3, zlib.DEFLATED, 31)
                            member = engine.compress(raw) + engine.flush()
                            out.write(member)
                            entries.append({"offset": offset, "length": len(member), "bytes": len(raw)})
                            offset += len(member)
                if cutter.held:
                    raise ValueError(f"{path} ends inside a record")
                with fs.open_output_stream(name + ".idx") as out:
                    out.write("".join(json.dumps(e) + "\n" for e in entries).encode())
                yield pa.RecordBatch.from_pydict({"path": [name], "records": [len(entries)]})

    return run


def write_monolithic(records: DataFrame, folder: str, roll: int = ARCHIVE_BYTES) -> DataFrame:
    """Write ``records`` (see record_types) as archives of one gzip stream each; (path, records) of each.

    The listing is committed with the job, so that files of attempts that failed are never read.
    """
    fs, root = _filesystem(folder)
    fs.create_dir(root)
    rows = records.select("page_id", "url", "payload", "payload_digest", "record_type", "refers_to")
    return materialise(map_texts(rows, _write_monolithic(folder, roll), "path string, records long"), "warc-listing")


def normalise(listing: DataFrame, folder: str) -> DataFrame:
    """Rewrite each archive of ``listing`` (path) with a gzip member for every record and a sidecar ``.idx``.

    Each file is inflated once from front to end. The sidecar has a JSON line with offset, length and
    uncompressed bytes for each record, in order.
    """
    fs, root = _filesystem(folder)
    fs.create_dir(root)
    # A row is a file here: each task takes some files.
    files = listing.select("path").repartition(max(1, min(4096, listing.count())), "path")
    return materialise(files.mapInArrow(_normalise(folder), "path string, records long"), "warc-normalised")


def _read(folder: str):
    schema = pa.schema(
        [("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
         ("record_type", pa.string()), ("refers_to", pa.int64()), ("offset", pa.int64())]
    )

    def run(batches):
        fs, _ = _filesystem(folder)
        for batch in batches:
            for path in batch.column(0).to_pylist():
                with fs.open_input_stream(path + ".idx") as index:
                    entries = [json.loads(x) for x in index.read().decode().splitlines()]
                rows = []
                with fs.open_input_file(path) as archive:
                    for e in entries:
                        archive.seek(e["offset"])
                        fields, block = parse_record(zlib.decompress(archive.read(e["length"]), 31))
                        digest = base64.b32decode(fields["warc-payload-digest"].removeprefix("sha1:")).hex()
                        payload = block[block.index(b"\r\n\r\n") + 4 :]
                        kind = fields["warc-type"]
                        if kind == "response" and hashlib.sha1(payload).hexdigest() != digest:
                            raise ValueError(f"{path} at {e['offset']}: the payload has another digest")
                        page = fields["warc-page-id"]
                        refers = fields.get("warc-refers-to-page-id", "")
                        size = len(payload) if kind == "response" else int(fields["warc-payload-length"])
                        rows.append((int(page) if page else None, size, digest, kind, int(refers) if refers else None, e["offset"]))
                if rows:
                    yield pa.RecordBatch.from_pydict(dict(zip(schema.names, zip(*rows))), schema=schema)

    return run


def read_archives(archives: DataFrame, folder: str) -> DataFrame:
    """Every record of normalised ``archives`` (path) through their sidecars, one member at a time."""
    files = archives.select("path").repartition(max(1, min(4096, archives.count())), "path")
    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, offset long"
    return files.mapInArrow(_read(folder), schema)


def round_trip(pages: DataFrame) -> DataFrame:
    """Write ``pages`` as archives, normalise them, drop the monolithic ones and read the rest back.

    An empty table gives no rows; any url or id may be null.
    """
    spark: SparkSession = pages.sparkSession
    folder = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    listing = write_monolithic(record_types(pages), f"{folder}/monolithic")
    archives = normalise(listing, f"{folder}/members")
    fs, root = _filesystem(folder)
    fs.delete_dir(f"{root}/monolithic")
    return read_archives(archives, f"{folder}/members")


def op3(pages: DataFrame) -> DataFrame:
    """The columns of the WARC contract."""
    return round_trip(pages).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP3_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, octet_length(encode(coalesce(html, ''))) AS n FROM pages),
d AS (SELECT page_id, n, sha1(html) AS digest FROM p),
r AS (SELECT *, CASE WHEN n >= 1000 THEN max(page_id) OVER (PARTITION BY digest, n) END AS first FROM d)
SELECT page_id, n AS payload_bytes, digest AS payload_digest,
  CASE WHEN first IS NOT NULL AND page_id IS DISTINCT FROM first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN first IS NOT NULL AND page_id IS DISTINCT FROM first THEN first END AS refers_to
FROM r
"""
