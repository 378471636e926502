"""Benchmark decontamination: an FM-index per shard of training text, searched for benchmark windows."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .fmindex import FMIndex
from .shared import ALNUM, Block, PrefixHash, map_texts, materialise, merged, text_blocks

WINDOW = 13
#: Benchmark text that is searched at a time; its windows are broadcast, and more takes more passes.
BENCHMARK_BYTES = 8 << 20
#: Bytes of training text in a shard.
SHARD_BYTES = 4 << 20
SPANS = "array<struct<w0:bigint,w1:bigint,c0:bigint,c1:bigint>>"


class Phrases:
    """The distinct windows of a block of benchmark items, over numbered words.

    An item of fewer than ``window`` words, but not none, is one window.
    """

    def __init__(self, ids: list[str], texts: list[bytes], window: int = WINDOW):
        block = Block(texts, ALNUM, lower=True)
        words = PrefixHash(block.raw).spans(block.word_starts, block.word_ends)
        self.ids = ids
        self.words, number = np.unique(words, return_inverse=True)
        #: Word numbers of all items; window k is ``flat[starts[k] : starts[k] + lengths[k]]``.
        self.flat = (number.reshape(-1) + 1).astype(np.int32)
        sizes = block.n_words
        count = np.where(sizes > 0, np.maximum(sizes - window, 0) + 1, 0)
        owner = np.repeat(np.arange(len(sizes)), count)
        starts = block.word_offsets[owner] + np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
        lengths = np.minimum(sizes, window)[owner]
        keys, first, same = np.unique(
            PrefixHash(self.flat).spans(starts, starts + lengths), return_index=True, return_inverse=True
        )
        self.starts, self.lengths = starts[first], lengths[first]
        held = np.unique(same.reshape(-1) * max(1, len(sizes)) + owner)
        #: Items that hold window k: ``holders[bounds[k] : bounds[k + 1]]``.
        self.holders = held % max(1, len(sizes))
        self.bounds = np.searchsorted(held // max(1, len(sizes)), np.arange(len(keys) + 1))

    def items(self, window: int) -> list[str]:
        """Ids of the items that hold a window."""
        return [self.ids[i] for i in self.holders[self.bounds[window] : self.bounds[window + 1]].tolist()]

    def number(self, hashes: np.ndarray) -> np.ndarray:
        """Number of each word, 0 for a word of no window."""
        if not len(self.words):
            return np.zeros(len(hashes), np.int64)
        at = np.minimum(np.searchsorted(self.words, hashes), len(self.words) - 1)
        return np.where(self.words[at] == hashes, at + 1, 0)


def occurrences(block: Block, phrases: Phrases) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(window, first word, last word + 1) of every occurrence of a window in one text of the shard.

    A word of no window cannot be part of an occurrence: runs of such words, and the ends of texts, are
    one separator each in the indexed sequence.
    """
    none = np.zeros(0, np.int64)
    if not len(phrases.starts) or not len(block.word_starts):
        return none, none, none
    number = phrases.number(PrefixHash(block.raw).spans(block.word_starts, block.word_ends))
    n = len(number)
    bounds = block.word_offsets[1:-1]
    # A separator stands before each text and at the end.
    text = np.insert(number, np.concatenate((bounds, [n])), 0)
    word = np.insert(np.arange(n), np.concatenate((bounds, [n])), -1)
    keep = (text > 0) | np.concatenate(([False], text[:-1] > 0))
    keep[-1] = True
    text, word = text[keep], word[keep]
    index = FMIndex(text)
    low, high = index.search(phrases.flat, phrases.starts, phrases.lengths)
    count = np.where(phrases.lengths > 0, np.maximum(high - low, 0), 0)
    window = np.repeat(np.arange(len(count)), count)
    rows = np.arange(len(window)) - np.repeat(np.cumsum(count) - count, count) + low[window]
    first = word[index.locate(rows)]
    return window, first, first + phrases.lengths[window]


def _merge(spans: list[tuple]) -> list[tuple]:
    out: list[list] = []
    for w0, w1, c0, c1 in sorted(spans):
        if out and w0 <= out[-1][1]:
            if w1 > out[-1][1]:
                out[-1][1], out[-1][3] = w1, c1
        else:
            out.append([w0, w1, c0, c1])
    return out


def scan(texts: list[bytes], phrases: Phrases) -> tuple[np.ndarray, dict[int, list], dict[int, set]]:
    """Words of each text, and merged spans and item ids of the texts with an occurrence."""
    block = Block(texts, ALNUM, lower=True)
    window, first, last = occurrences(block, phrases)
    spans: dict[int, list] = {}
    items: dict[int, set] = {}
    if len(window):
        owner = np.searchsorted(block.word_offsets, first, side="right") - 1
        chars = np.concatenate(([0], np.cumsum((block.raw & 0xC0) != 0x80)))
        base, offset = chars[block.starts], block.word_offsets
        by = np.lexsort((first, owner))
        for t, k, a, b in zip(owner[by].tolist(), window[by].tolist(), first[by].tolist(), last[by].tolist()):
            c0, c1 = int(chars[block.word_starts[a]] - base[t]), int(chars[block.word_ends[b - 1]] - base[t])
            spans.setdefault(t, []).append((a - int(offset[t]), b - int(offset[t]), c0, c1))
            items.setdefault(t, set()).update(phrases.items(k))
    return block.n_words, {t: _merge(s) for t, s in spans.items()}, items


def _pass(phrases, shard_bytes: int, last_pass: bool):
    def run(batches):
        known = phrases.value
        for batch in merged(batches, "text", shard_bytes):
            names = batch.schema.names
            at = {c: batch.column(names.index(c)) for c in names}
            for first, last, texts in text_blocks(at["text"], shard_bytes):
                n_words, spans, items = scan(texts, known)
                old_spans = at["_spans"].slice(first, last - first).to_pylist()
                old_items = at["_items"].slice(first, last - first).to_pylist()
                new_spans, new_items = [], []
                for i, (s, ids) in enumerate(zip(old_spans, old_items)):
                    if i in spans:
                        s = [tuple(x.values()) for x in s] + [tuple(x) for x in spans[i]]
                        s = [dict(zip(("w0", "w1", "c0", "c1"), x)) for x in _merge(s)]
                        ids = sorted(items[i].union(ids))
                    new_spans.append(s)
                    new_items.append(ids)
                part = {c: at[c].slice(first, last - first) for c in names}
                part["_words"] = pa.array(n_words, pa.int64())
                part["_spans"] = pa.array(new_spans, batch.schema.field("_spans").type)
                part["_items"] = pa.array(new_items, batch.schema.field("_items").type)
                if last_pass:
                    del part["text"]
                yield pa.RecordBatch.from_pydict(part)

    return run


def contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    keep: tuple[str, ...] = (),
    window: int = WINDOW,
    benchmark_bytes: int = BENCHMARK_BYTES,
    shard_bytes: int = SHARD_BYTES,
) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated, removal ``spans`` for every row of ``docs``.

    ``spans`` holds the merged occurrences as words [w0, w1) and code points [c0, c1). ``keep`` names
    further columns of ``docs`` to carry. A null text has no words; items with one id count once and a
    null id is the empty string; empty tables are allowed. Documents are not shuffled: every shard is a
    run of whole documents of one partition, across Arrow batches. The benchmark goes to the driver in
    blocks of about ``benchmark_bytes``, one after the other, each of which is broadcast for a pass over
    the documents; between passes the rows are written and the block is given up. Repeated rows get equal
    results, a very long text is a shard of its own, and columns of ``docs`` with the names used here
    do not disturb.
    """
    spark = docs.sparkSession
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), "text")
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    passes = max(1, -(-total // benchmark_bytes))
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        *(F.col(c).alias(f"keep_{c}") for c in keep),
        "text",
        F.lit(0).cast("long").alias("_words"),
        F.array().cast(SPANS).alias("_spans"),
        F.array().cast("array<string>").alias("_items"),
    )
    for k in range(passes):
        mine = items if passes == 1 else items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(passes)) == k)
        found = mine.collect()
        phrases = Phrases([r["item_id"] for r in found], [(r["text"] or "").encode() for r in found], window)
        last = k == passes - 1
        kept = [f for f in rows.schema.fields if f.name != "text" or not last]
        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept)
        shared = spark.sparkContext.broadcast(phrases)
        rows = map_texts(rows, _pass(shared, shard_bytes, last), schema)
        if not last:
            rows = materialise(rows, "decontamination-pass")
            shared.unpersist()
    hit = F.aggregate("_spans", F.lit(0).cast("long"), lambda total, s: total + s["w1"] - s["w0"])
    rows = rows.withColumn("n_hit", hit)
    return rows.select(
        "doc_id",
        F.col("_words").alias("n_words"),
        "n_hit",
        F.size("_items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("_items"), ","), 256).alias("items_sha256"),
        ((F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("_words"))).alias("contaminated"),
        F.col("_spans").alias("spans"),
        *(f"keep_{c}" for c in keep),
    )


def op5(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The columns of the decontamination contract."""
    return contamination(docs, benchmark).drop("spans")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are not contaminated, unchanged.

    Null and empty texts stay, equal rows share a verdict, an empty table gives no rows, and no column of ``docs`` disturbs.
    """
    packed = docs.select(F.struct("*").alias("row"), "doc_id", "text")
    return contamination(packed, benchmark, keep=("row",)).filter("not contaminated").select("keep_row.*")


OP5_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS n, doc_id, regexp_extract_all(translate(coalesce(text, ''),
  'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''),
  'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+') AS w FROM benchmark),
iw AS (SELECT DISTINCT item_id, m, array_to_string(w[i:i + m - 1], ' ') AS run
  FROM (SELECT *, least(13, len(w)) AS m FROM b WHERE len(w) > 0), unnest(range(1, len(w) - m + 2)) AS u(i)),
sizes AS (SELECT DISTINCT m FROM iw),
dw AS (SELECT n, m, i, array_to_string(w[i:i + m - 1], ' ') AS run FROM d, sizes, unnest(range(1, len(w) - m + 2)) AS u(i)),
hit AS (SELECT n, i, m, item_id FROM dw JOIN iw USING (m, run)),
words AS (SELECT n, count(DISTINCT i + k) AS n_hit FROM hit, unnest(range(0, 13)) AS v(k) WHERE k < m GROUP BY n),
items AS (SELECT n, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids
  FROM (SELECT DISTINCT n, CAST(item_id AS VARCHAR) AS id FROM hit) GROUP BY n)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN words USING (n) LEFT JOIN items USING (n)
"""
