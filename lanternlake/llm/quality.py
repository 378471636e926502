"""Quality rules: base text statistics and cross-document line frequency."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import SPACE_SEPARATED, Block, PrefixHash, byte_class, map_texts, materialise, mix64, row_key, text_blocks, with_text

SYMBOLS = byte_class(b"#*$%&|<>")
UPPER, LOWERED = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: A line is boilerplate of its host when more distinct documents of the host hold it than this number and
#: than the square root of the host's documents, which grows slower than the host.
MIN_LINE_DOCS = 30
#: A document is depleted when fewer than this share of its words is left.
MIN_WORDS_LEFT = 0.5


def _repeated(keys: np.ndarray) -> np.ndarray:
    """Which keys occur twice or more."""
    order = np.argsort(keys)
    same = np.diff(keys[order]) == 0
    flags = np.zeros(len(keys), bool)
    flags[order[:-1][same]] = True
    flags[order[1:][same]] = True
    return flags


def base_statistics(texts: list[bytes]) -> dict[str, np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of each text."""
    block = Block(texts, SPACE_SEPARATED)
    raw, n = block.raw, len(texts)
    in_word = SPACE_SEPARATED[raw]
    hashes = PrefixHash(raw)

    line_ends = np.flatnonzero(raw == 10)
    line_starts = np.concatenate(([0], line_ends[:-1] + 1))
    words_before = np.searchsorted(block.word_starts, line_starts)
    words_after = np.searchsorted(block.word_starts, line_ends)
    worded = words_after > words_before
    starts, ends = line_starts[worded], line_ends[worded]
    text_of = np.searchsorted(block.starts, starts, side="right") - 1
    keys = mix64(hashes.spans(starts, ends) + text_of.astype(np.uint64) * np.uint64(0xA24BAED4963EE407))
    order = np.argsort(keys, kind="stable")
    later = np.zeros(len(keys), bool)
    later[order[1:][np.diff(keys[order]) == 0]] = True
    n_dup = np.bincount(text_of[later], minlength=n)

    words = hashes.spans(block.word_starts, block.word_ends)
    covered = np.zeros(len(words), bool)
    if len(words) > 2:
        owner = block.word_text()
        first = np.flatnonzero(owner[:-2] == owner[2:])
        window = mix64(words[first] * np.uint64(3) + owner[first].astype(np.uint64))
        window = mix64(window * np.uint64(5) + words[first + 1])
        window = mix64(window * np.uint64(7) + words[first + 2])
        twice = first[_repeated(window)] if len(window) else first
        for shift in range(3):
            covered[twice + shift] = True
    return {
        "n_words": block.n_words,
        "word_chars": block.per_text(in_word & ((raw & 0xC0) != 0x80)),
        "n_symbols": block.per_text(SYMBOLS[raw]),
        "n_dup_lines": n_dup,
        "n_repeat_words": block.per_words(covered),
    }


_BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def _distinct_lines(lines: pa.ListArray) -> pa.ListArray:
    """The lines of each row once, with their words in all."""
    owner = np.repeat(np.arange(len(lines)), np.diff(lines.offsets.to_numpy()))
    flat = lines.flatten()
    h, w = flat.field("h").to_numpy(), flat.field("w").to_numpy()
    order = np.lexsort((h, owner))
    h, w, owner = h[order], w[order], owner[order]
    first = np.flatnonzero(np.concatenate(([True], (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])))) if len(h) else np.zeros(0, np.int64)
    sums = np.add.reduceat(w, first) if len(first) else w
    bounds = np.searchsorted(owner[first], np.arange(len(lines) + 1))
    values = pa.StructArray.from_arrays([pa.array(h[first]), pa.array(sums, pa.int32())], ["h", "w"])
    return pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), values)


def _with_base(batches):
    for batch in batches:
        text = batch.column(batch.schema.get_field_index("text"))
        lines = _distinct_lines(batch.column(batch.schema.get_field_index("_lines")))
        rest = batch.drop_columns(["text", "_lines"]).append_column("_lines", lines)
        for first, last, texts in text_blocks(text):
            found = base_statistics(texts)
            part = rest.slice(first, last - first)
            yield pa.RecordBatch.from_arrays(
                [*part.columns, *(pa.array(found[c], pa.int64()) for c in _BASE)], [*part.schema.names, *_BASE]
            )


def _line_key(line: Column, host: Column) -> Column:
    return F.xxhash64(line, F.coalesce(host, F.lit("")), host.isNull())


def _normalised(line: Column) -> Column:
    """A-Z lower-cased, each run of white space one space, none at the ends."""
    return F.trim(F.regexp_replace(F.translate(line, UPPER, LOWERED), r"[\x20\x09-\x0D]+", " "))


def line_statistics(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, host, content key, document, base statistics and its distinct hashed lines.

    Rows with one doc_id are one document; without an id, equal rows are.
    """
    schema = "doc_id long, _host string, _k1 long, _k2 long, _doc long, _lines array<struct<h:bigint,w:int>>, "
    schema += ", ".join(f"{c} long" for c in _BASE)
    lines = F.filter(F.transform(F.split("text", "\n", -1), _normalised), lambda x: x != "")
    hashed = F.transform(
        lines,
        lambda x: F.struct(
            _line_key(x, F.col("source")).alias("h"),
            (F.length(x) - F.length(F.replace(x, F.lit(" "))) + 1).cast("int").alias("w"),
        ),
    )
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("source").alias("_host"),
        *row_key("doc_id", "source", "text"),
        F.coalesce(F.col("doc_id").cast("long"), row_key("doc_id", "source", "text")[0]).alias("_doc"),
        F.coalesce(hashed, F.array().cast("array<struct<h:bigint,w:int>>")).alias("_lines"),
        "text",
    )
    return map_texts(rows, _with_base, schema)


def frequent_lines(stats: DataFrame, min_docs: int = MIN_LINE_DOCS) -> DataFrame:
    """Keys of lines in more than max(min_docs, sqrt(documents of the host)) distinct documents of a host.

    Counts are partial before each shuffle, so a line that a third of all documents hold costs a row for
    each document once, and one for each task in the count.
    """
    docs = stats.select("_host", "_doc").distinct()
    limits = docs.groupBy("_host").agg(F.greatest(F.lit(float(min_docs)), F.sqrt(F.count("*"))).alias("_limit"))
    held = stats.select("_host", "_doc", F.explode("_lines.h").alias("_line")).distinct()
    counts = held.groupBy("_host", "_line").agg(F.count("*").alias("_docs")).filter(F.col("_docs") > min_docs)
    limits = materialise(limits, "line-limits")
    return (
        counts.join(limits, counts["_host"].eqNullSafe(limits["_host"]))
        .filter(F.col("_docs") > F.col("_limit"))
        .select("_line")
    )


def quality_decisions(docs: DataFrame, min_docs: int = MIN_LINE_DOCS, min_left: float = MIN_WORDS_LEFT) -> DataFrame:
    """One row per row of ``docs`` with base statistics, ``base_failed``, ``kept`` and removed lines.

    ``source`` is the host. A null text has no words and fails; an empty table gives no rows; equal rows
    get equal decisions; a null host is a host of its own; other columns are not read; a very long text
    costs its lines once, however many of them go. ``kept`` is false where the base rules fail or removing
    frequent lines leaves fewer than ``min_left`` of the words.
    """
    stats = materialise(line_statistics(docs), "line-statistics")
    frequent = materialise(frequent_lines(stats, min_docs), "frequent-lines")
    lines = stats.select("_k1", "_k2", F.explode("_lines").alias("_line"))
    # Equal rows have equal lines, which the set holds once.
    removed = (
        lines.join(frequent.withColumnRenamed("_line", "_h"), F.col("_line.h") == F.col("_h"), "left_semi")
        .groupBy("_k1", "_k2")
        .agg(F.collect_set("_line").alias("_gone"))
    )
    gone = F.aggregate("_gone", F.lit(0).cast("long"), lambda total, x: total + x["w"])
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return (
        stats.join(removed, ["_k1", "_k2"], "left")
        .withColumn("_removed", F.coalesce("_gone.h", F.array().cast("array<long>")))
        .withColumn("words_left", F.col("n_words") - F.coalesce(gone, F.lit(0)))
        .withColumn("base_failed", failed)
        .withColumn("kept", ~failed & (F.col("words_left") >= min_left * F.col("n_words")))
    )


def op1(docs: DataFrame) -> DataFrame:
    """The columns of the quality contract."""
    return quality_decisions(docs).select("doc_id", *_BASE, "base_failed", "kept", "words_left")


def _cut(batches):
    for batch in batches:
        at = {c: batch.column(batch.schema.get_field_index(c)) for c in ("text", "_keys", "_removed")}
        texts = []
        for text, keys, removed in zip(at["text"], at["_keys"], at["_removed"]):
            text = text.as_py()
            if len(removed):
                goes = np.isin(keys.values.to_numpy(), removed.values.to_numpy())
                text = "\n".join([line for line, out in zip(text.split("\n"), goes.tolist()) if not out])
            texts.append(text)
        yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index("_row")), pa.array(texts, pa.string())], ["_row", "_kept_text"])


def quality_filter(docs: DataFrame) -> DataFrame:
    """Kept documents, with their frequent lines cut out; the columns of ``docs``.

    ``n_chars``, where present, is set to the length of the remaining text. Null and empty texts go, equal rows are cut
    alike and all stay, a null source is a host of its own, an empty table gives no rows, and no column of
    ``docs`` disturbs.
    """
    rulings = (
        quality_decisions(docs)
        .filter("kept")
        .select("_k1", "_k2", "_removed")
        .groupBy("_k1", "_k2")
        .agg(F.first("_removed").alias("_removed"))
    )
    keyed = docs.select(F.struct("*").alias("_row"), "text", "source", *row_key("doc_id", "source", "text"))
    keys = F.transform(F.split("text", "\n", -1), lambda x: _line_key(_normalised(x), F.col("source")))
    # Only texts that lose lines need the keys of their lines.
    keys = F.when(F.size("_removed") > 0, keys).otherwise(F.array().cast("array<long>"))
    joined = keyed.join(rulings, ["_k1", "_k2"]).select("_row", "text", keys.alias("_keys"), "_removed")
    kind = docs.select(F.struct("*").alias("_row")).schema["_row"].dataType.simpleString()
    return with_text(map_texts(joined, _cut, f"_row {kind}, _kept_text string"), docs)


OP1_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS n, doc_id, source, coalesce(text, '') AS t,
  coalesce(CAST(doc_id AS VARCHAR), md5(concat_ws('|', source, text))) AS doc FROM documents),
w AS (SELECT n, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w FROM d),
g AS (SELECT n, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS run FROM w, unnest(range(1, len(w) - 1)) AS u(i)),
rep AS (SELECT n, count(DISTINCT i + k) AS n_repeat_words
  FROM (SELECT n, i, count(*) OVER (PARTITION BY n, run) AS c FROM g), unnest([0, 1, 2]) AS v(k) WHERE c > 1 GROUP BY n),
l AS (SELECT n, source, doc, line, trim(regexp_replace(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
  'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+', ' ', 'g')) AS norm
  FROM (SELECT n, source, doc, unnest(string_split(t, chr(10))) AS line FROM d)),
worded AS (SELECT *, len(string_split(norm, ' ')) AS words FROM l WHERE norm <> ''),
dup AS (SELECT n, count(*) - count(DISTINCT line) AS n_dup_lines FROM worded GROUP BY n),
host AS (SELECT source, greatest(30, sqrt(count(DISTINCT doc))) AS most FROM d GROUP BY source),
frequent AS (SELECT c.source, norm FROM (SELECT source, norm, count(DISTINCT doc) AS docs FROM worded GROUP BY 1, 2) c
  JOIN host h ON c.source IS NOT DISTINCT FROM h.source WHERE docs > most),
left_ AS (SELECT n, CAST(sum(CASE WHEN f.norm IS NULL THEN words ELSE 0 END) AS BIGINT) AS words_left
  FROM worded x LEFT JOIN frequent f ON x.norm = f.norm AND x.source IS NOT DISTINCT FROM f.source GROUP BY n),
base AS (SELECT doc_id, len(w) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
  length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines,
  coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(words_left, 0) AS words_left
  FROM d JOIN w USING (n) LEFT JOIN rep USING (n) LEFT JOIN dup USING (n) LEFT JOIN left_ USING (n))
SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND words_left >= 0.5 * n_words AS kept FROM base
"""
