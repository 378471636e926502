"""Shared-folder helpers and byte-level text arrays used by several operators."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space that separates words in the word contracts: space and \x09-\x0D.
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """Folder that the driver and all executors see: ``spark.checkpoint.dir``.

    Where the session has none (a local test), a temporary folder is set for the session.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        context_folder = spark.sparkContext.getCheckpointDir()
        if context_folder:
            return re.sub(r"^file:/(?=[^/])", "file:///", context_folder)
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="lanternlake-")
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet below the shared folder and return it read again.

    Later plans then know its true size, so that Spark broadcasts it only below
    ``spark.sql.autoBroadcastJoinThreshold`` and shuffles both sides otherwise.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def row_key(*columns: str | Column) -> list[Column]:
    """Two independent 64-bit content hashes; equal rows share them, nulls are told from empty values."""
    values = [F.col(c) if isinstance(c, str) else c for c in columns]
    parts = [part for v in values for part in (v, v.isNull())]
    return [
        F.xxhash64(F.lit(1), *parts).alias("_k1"),
        F.xxhash64(F.lit(2), *reversed(parts)).alias("_k2"),
    ]


#: Rows and bytes of an Arrow batch for tables with texts.
BATCH_ROWS, BATCH_BYTES = 512, 4 << 20


def map_texts(rows: DataFrame, function, schema: str) -> DataFrame:
    """``mapInArrow`` in small batches.

    Arrow holds a batch outside the heap on both sides of the pipe, and its buffers double as they grow. A
    session with larger batches is set to BATCH_ROWS and BATCH_BYTES. Plans run after this call returns, so
    both settings stay for the session; they bound memory and change no result.
    """
    conf = rows.sparkSession.conf
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(conf.get(name)) <= BATCH_ROWS:
        conf.set(name, str(BATCH_ROWS))
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if not re.fullmatch(r"\d+b?", conf.get(name)) or not 0 < int(conf.get(name).rstrip("b")) <= BATCH_BYTES:
        conf.set(name, str(BATCH_BYTES))
    return rows.mapInArrow(function, schema)


def all_columns(docs: DataFrame) -> list[Column]:
    """Every column of ``docs`` in a form that can be hashed; maps are taken as JSON."""
    quoted = [(F.col(f"`{c.replace('`', '``')}`"), kind) for c, kind in docs.dtypes]
    return [F.to_json(F.struct(c)) if "map<" in kind else c for c, kind in quoted]


def with_text(rows: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of ``docs`` from the struct ``_row``, with ``text`` replaced by ``_kept_text``.

    ``n_chars``, where present, is set to the length of the new text.
    """
    new = {"text": F.col("_kept_text")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.length("_kept_text").cast(docs.schema["n_chars"].dataType)
    return rows.select(*(new.get(c, F.col("_row").getField(c)).alias(c) for c in docs.columns))


# --- byte-level text arrays -------------------------------------------------------------------

_P = np.uint64(0x9E3779B97F4A7C15)
_P_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        size = max(n, 1 << 20)
        for slot, base in ((0, _P), (1, _P_INV)):
            table = np.full(size, base, np.uint64)
            table[0] = 1
            _powers[slot] = np.cumprod(table)
    return _powers[0][:n], _powers[1][:n]


def mix64(x: np.ndarray) -> np.ndarray:
    """Bijective finaliser over uint64."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


class PrefixHash:
    """Hash of any span of a sequence in constant time, from one prefix sum modulo 2**64."""

    def __init__(self, values: np.ndarray):
        power, self.inverse = _power_tables(len(values) + 1)
        self.sums = np.empty(len(values) + 1, np.uint64)
        self.sums[0] = 0
        np.cumsum((values.astype(np.uint64) + np.uint64(1)) * power[:-1], out=self.sums[1:])

    def spans(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        raw = (self.sums[ends] - self.sums[starts]) * self.inverse[starts]
        return mix64(raw + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def byte_class(members) -> np.ndarray:
    """256-entry boolean table."""
    table = np.zeros(256, bool)
    table[list(members)] = True
    return table


SPACE_SEPARATED = ~byte_class([0x20, *range(0x09, 0x0E)])
#: Words of the decontamination contract, after A-Z are lower-cased; every byte of a non-ASCII character counts.
ALNUM = byte_class([*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)])
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


def merged(batches: Iterator[pa.RecordBatch], column: str, block_bytes: int) -> Iterator[pa.RecordBatch]:
    """Successive batches joined until ``column`` holds about ``block_bytes``."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        held.append(batch)
        size += batch.column(batch.schema.get_field_index(column)).nbytes
        if size >= block_bytes:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held, size = [], 0
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def text_blocks(column: pa.Array, block_bytes: int = 1 << 21) -> Iterator[tuple[int, int, list[bytes]]]:
    """Runs of whole rows of about ``block_bytes`` (first row, last row + 1, texts); null gives b''.

    A row longer than that stands alone, so memory follows the longest text and not the batch.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    first, texts, held = 0, [], 0
    for i, value in enumerate(column):
        raw = value.as_py() or b""
        if texts and held + len(raw) > block_bytes:
            yield first, i, texts
            first, texts, held = i, [], 0
        texts.append(raw)
        held += len(raw) + 1
    if texts:
        yield first, first + len(texts), texts


class Block:
    """Texts joined by a line feed as one byte array, with word spans per text."""

    def __init__(self, texts: list[bytes], word_table: np.ndarray, lower: bool = False):
        self.raw = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
        if lower:
            self.raw = LOWER[self.raw]
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        self.ends = np.cumsum(lengths + 1) - 1
        self.starts = self.ends - lengths
        edges = np.flatnonzero(np.diff(np.concatenate(([False], word_table[self.raw], [False])).view(np.int8)))
        self.word_starts, self.word_ends = edges[::2], edges[1::2]
        #: Words before each text, and in all at the end.
        self.word_offsets = np.append(np.searchsorted(self.word_starts, self.starts), len(self.word_starts))
        self.n_words = np.diff(self.word_offsets)

    def per_text(self, flags: np.ndarray) -> np.ndarray:
        """Sum of a per-byte value over each text."""
        total = np.concatenate(([0], np.cumsum(flags, dtype=np.int64)))
        return total[self.ends] - total[self.starts]

    def per_words(self, flags: np.ndarray) -> np.ndarray:
        """Sum of a per-word value over each text."""
        total = np.concatenate(([0], np.cumsum(flags, dtype=np.int64)))
        return np.diff(total[self.word_offsets])

    def word_text(self) -> np.ndarray:
        """Index of the text that holds each word."""
        return np.repeat(np.arange(len(self.starts)), self.n_words)
