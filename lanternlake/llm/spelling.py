"""Spelling variants: words at one edit, found through forward and reversed sorted dictionaries."""

from __future__ import annotations

import math
from collections import Counter
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import LOWER, map_texts, materialise, text_blocks

MIN_LENGTH, MIN_COUNT = 6, 5
#: A form occurs at least so many times as often as its variant.
TIMES = 5
#: One in so many (document, word) pairs loses a code point.
MISPRINT = 199
#: Words of a block that are compared directly; larger blocks are subdivided.
BLOCK = 256
#: Distinct words that a task counts before it hands them on.
HELD_WORDS = 200_000
#: Cells of one comparison of code points.
CELLS = 1 << 22

_LETTER = np.zeros(256, bool)
_LETTER[0x61:0x7B] = True


def _misprinted(word: bytes, hashed: int) -> bytes | None:
    text = word.decode()
    if len(text) == MIN_LENGTH:
        return None
    at = hashed % len(text)
    return (text[:at] + text[at + 1 :]).encode()


def _count_words(batches):
    """(word, n) of the batches: runs of letters as UTF-8, where U+00C0 to U+00FF are 0xC3 and one byte more."""
    held: Counter = Counter()

    def rows():
        return pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.binary()).cast(pa.string()), pa.array(held.values(), pa.int64())], ["word", "n"])

    for batch in batches:
        ids = batch.column(batch.schema.get_field_index("id")).to_pylist()
        for first, _, texts in text_blocks(batch.column(batch.schema.get_field_index("text"))):
            raw = LOWER[np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)]
            lead = raw == 0xC3
            letter = _LETTER[raw] | lead
            letter[1:] |= lead[:-1]
            edges = np.flatnonzero(np.diff(np.concatenate(([False], letter, [False])).view(np.int8)))
            starts, ends = edges[::2], edges[1::2]
            wide = np.concatenate(([0], np.cumsum(lead)))
            long_ = ends - starts - (wide[ends] - wide[starts]) >= MIN_LENGTH
            starts, ends = starts[long_], ends[long_]
            limits = np.searchsorted(starts, np.cumsum([len(t) + 1 for t in texts])).tolist()
            data, begin = raw.tobytes(), 0
            for number, end in enumerate(limits):
                known = ids[first + number]
                seed = crc32(b":" if known is None else b"%d:" % known)
                words = [data[s:e] for s, e in zip(starts[begin:end].tolist(), ends[begin:end].tolist())]
                begin = end
                hashes = [crc32(w, seed) for w in words]
                for i, h in enumerate(hashes):
                    if not h % MISPRINT:
                        words[i] = _misprinted(words[i], h)
                held.update(words)
            held.pop(None, None)
            if len(held) >= HELD_WORDS:
                yield rows()
                held.clear()
    if held:
        yield rows()


def dictionary(docs: DataFrame, min_count: int = MIN_COUNT) -> DataFrame:
    """(word, n) of the words with at least MIN_LENGTH code points and ``min_count`` occurrences.

    Tasks count what they read before anything is shuffled. A null text has no words, a null doc_id counts as empty
    text in the misprints, an empty table has no words; rows are never made distinct, so a repeated row counts again.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("id"), "text")
    counted = map_texts(rows, _count_words, "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= min_count)


def _entries(words: DataFrame) -> DataFrame:
    """A row for each place of a word in the forward (b = 0) and the reversed dictionary (a = 0).

    Of two near words let m be the length of the shorter and h = m // 2. If the edit is at position h or later, the
    first h code points are intact, else the last m - h. So a word stands under m = its length and, as the
    longer of a pair, under one less. In general a block (m, a, b, key) holds words with the same first a
    and last b code points, and stands for the pairs whose edit is at a or later and before m - b.
    """
    size = F.length("word")
    half = F.floor(F.col("m") / 2).cast("int")
    both = words.select("word", "n", F.explode(F.array(size, size - 1)).alias("m"))
    split = F.explode(F.array(F.struct(half.alias("a"), F.lit(0).alias("b")), F.struct(F.lit(0).alias("a"), (F.col("m") - half).alias("b"))))
    return _keyed(both.select("word", "n", "m", split.alias("s")).select("word", "n", "m", "s.a", "s.b"))


def _keyed(rows: DataFrame) -> DataFrame:
    # Code points of words are letters, so a space parts both ends.
    end = F.when(F.col("b") > 0, F.reverse(F.expr("right(word, b)"))).otherwise("")
    return rows.withColumn("key", F.concat(F.expr("left(word, a)"), F.lit(" "), end))


BLOCK_KEY = ["m", "a", "b", "key"]


def _halved(rows: DataFrame) -> DataFrame:
    """Entries of the two halves of each block: one more intact part before the edit, or behind it."""
    part = F.floor((F.col("m") - F.col("a") - F.col("b")) / 2).cast("int")
    rest = F.col("m") - F.col("a") - F.col("b")
    two = F.array(F.struct((F.col("a") + part).alias("a"), "b"), F.struct("a", (F.col("b") + rest - part).alias("b")))
    return _keyed(rows.select("word", "n", "m", F.explode(two).alias("s")).select("word", "n", "m", "s.a", "s.b"))


def blocks(words: DataFrame, limit: int = BLOCK) -> DataFrame:
    """Entries of all blocks with several words; one above ``limit`` is halved until it fits.

    A block whose words differ in one place only is left: it has at most an alphabet of short words.
    """
    open_, parts = _entries(words), []
    while True:
        sizes = open_.groupBy(*BLOCK_KEY).agg(F.count("*").alias("size"), F.count_if(F.length("word") == F.col("m")).alias("short"))
        # Longer words of a block meet in the block of their own length.
        sizes = sizes.filter("size > 1 and short > 0")
        sized = materialise(open_.join(sizes, BLOCK_KEY), "spelling-blocks")
        too_large = (F.col("size") > limit) & (F.col("m") - F.col("a") - F.col("b") > 1)
        parts.append(sized.filter(~too_large).select("word", "n", *BLOCK_KEY))
        large = sized.filter(too_large)
        if large.isEmpty():
            break
        open_ = _halved(large)
    out = parts[0]
    for part in parts[1:]:
        out = out.union(part)
    return out


def _points(words: list[str], length: int) -> np.ndarray:
    return np.array(words, dtype=f"<U{length}").view(np.uint32).reshape(len(words), length)


def near_in_block(short: list[str], long_: list[str], m: int, a: int, b: int) -> list[tuple[int, int]]:
    """Numbers of near words (the long ones count on), of which the edit lies in the block's part.

    The place of an edit is the first position where the words differ, so a pair belongs to one block only.
    """
    found, x = [], _points(short, m)
    others = [(0, x, x)]
    if long_:
        y = _points(long_, m + 1)
        others.append((len(short), y[:, :m], y[:, 1:]))
    for offset, start, shifted in others:
        step = max(1, CELLS // max(1, len(start) * m))
        for low in range(0, len(short), step):
            same = x[low : low + step, None, :] == start[None, :, :]
            first = np.where(same.all(axis=2), m, np.argmin(same, axis=2))
            if offset:
                equal = x[low : low + step, None, ::-1] == shifted[None, :, ::-1]
                last = np.where(equal.all(axis=2), m, np.argmin(equal, axis=2))
                near = first + last >= m
            else:
                near = (m - same.sum(axis=2) == 1) & (np.arange(len(short))[None, :] > np.arange(low, low + len(same))[:, None])
            near &= first >= a
            if b:
                near &= first < m - b
            i, j = np.nonzero(near)
            found += zip((i + low).tolist(), (j + offset).tolist())
    return found


def _scan(batches):
    """Near pairs, both ways, of the sorted entries of a partition; a block is contiguous and may span batches."""
    block, key = [], None

    def pairs():
        m, a, b, _ = key
        short, long_ = [r for r in block if len(r[0]) == m], [r for r in block if len(r[0]) > m]
        if not short or len(block) < 2:
            return []
        rows = short + long_
        return [(rows[i], rows[j]) for i, j in near_in_block([r[0] for r in short], [r[0] for r in long_], m, a, b)]

    def table(found):
        both = [(u, v, k) for (u, _), (v, k) in found] + [(v, u, k) for (u, k), (v, _) in found]
        columns = zip(*both) if both else ([], [], [])
        return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, (pa.string(), pa.string(), pa.int64()))], ["word", "near", "near_n"])

    for batch in batches:
        found = []
        columns = [batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("word", "n", *BLOCK_KEY)]
        for word, n, *own in zip(*columns):
            if own != key:
                if key is not None:
                    found += pairs()
                block, key = [], own
            block.append((word, n))
        yield table(found)
    if key is not None:
        yield table(pairs())


def near_words(words: DataFrame, limit: int = BLOCK) -> DataFrame:
    """(word, near, near_n) of all pairs of ``words`` (word, n) at one edit, both ways and once each."""
    entries = blocks(words, limit)
    # All words of a block fall into one range, sorted by what they share.
    ranged = entries.repartitionByRange(*BLOCK_KEY).sortWithinPartitions(*BLOCK_KEY)
    return ranged.mapInArrow(_scan, "word string, near string, near_n long")


def with_roots(words: DataFrame, times: int = TIMES) -> DataFrame:
    """Adds root: the end of the forms from each word on. ``words`` has word, n and form.

    Each form occurs ``times`` as often as the word before, so the largest count bounds the steps; they are
    doubled with every join.
    """
    most = words.agg(F.max("n")).first()[0] or 1
    least = words.agg(F.min("n")).first()[0] or 1
    steps = int(math.log(max(1.0, most / least), times) + 1e-9)
    roots = words.filter("form is not null").select("word", F.col("form").alias("root"))
    for _ in range(max(0, steps - 1).bit_length()):
        on = roots.select(F.col("word").alias("root"), F.col("root").alias("further"))
        roots = materialise(roots.join(on, "root", "left").select("word", F.coalesce("further", "root").alias("root")), "spelling-roots")
    return words.join(roots, "word", "left").withColumn("root", F.coalesce("root", "word"))


def variants(docs: DataFrame, times: int = TIMES, limit: int = BLOCK) -> DataFrame:
    """word, n, n_near, form, form_n and root of the dictionary of ``docs`` (doc_id, text).

    A word's form is its near word of the largest n, the first in code-point order among equals, if that is ``times``
    the word's n or more. Other columns of ``docs`` are not read.
    """
    words = materialise(dictionary(docs), "dictionary")
    near = near_words(words, limit).groupBy("word").agg(
        F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near").alias("form"))).alias("best")
    )
    is_form = -F.col("best.less") >= F.col("n") * times
    formed = words.join(near, "word", "left").select(
        "word",
        "n",
        F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
        F.when(is_form, F.col("best.form")).alias("form"),
        F.when(is_form, -F.col("best.less")).alias("form_n"),
    )
    return with_roots(materialise(formed, "spelling-forms"), times)


def op13(docs: DataFrame) -> DataFrame:
    """The columns of the spelling contract."""
    return variants(docs).select("word", "form", "root", "n", "n_near", "form_n")
