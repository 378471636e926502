"""A BM25 index in blocks of documents with score bounds, and the search that leaves blocks out by them."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import channel_tokens
from ..sources.work import small_batches, small_table, work_table

K1, B, EPSILON = 1.5, 0.75, 0.25
#: Documents of a block.
DOCUMENTS = 32
#: Queries and distinct terms of queries that are searched for at a time.
QUERY_BLOCK, TERM_BLOCK = 1024, 500_000
#: Blocks by the highest bounds of which a query's first threshold is taken.
SEEDS = 2
#: Part of all blocks below which the blocks to be scored are picked by a join; above, all are read in place.
FEW = 0.1
#: Scores that are held before they are merged.
HELD = 200_000


class Best:
    """The ``k`` best candidates of each query so far, equal scores by id."""

    def __init__(self, queries: int, k: int, floor: np.ndarray):
        self.k, self.floor, self.every = k, floor.copy(), np.arange(queries)
        self.query, self.score, self.idx = np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64)
        self.held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.size = 0

    def offer(self, query: np.ndarray, score: np.ndarray, idx: np.ndarray) -> None:
        good = score >= self.floor[query]
        self.held.append((query[good], score[good], idx[good]))
        self.size += len(self.held[-1][0])
        if self.size >= HELD:
            self.merge()

    def merge(self) -> None:
        query, score, idx = (np.concatenate(x) for x in zip((self.query, self.score, self.idx), *self.held))
        order = np.lexsort((idx, -score, query))
        query, score, idx = query[order], score[order], idx[order]
        place = np.arange(len(query)) - np.searchsorted(query, self.every)[query]
        full = place == self.k - 1
        self.floor[query[full]] = np.maximum(self.floor[query[full]], score[full])
        kept = place < self.k
        self.query, self.score, self.idx = query[kept], score[kept], idx[kept]
        self.held, self.size = [], 0


# --- the index ---------------------------------------------------------------------------------


def _counted(batches):
    """Distinct terms of each document in order, their numbers, and its most frequent term."""
    for batch in batches:
        lists = batch.column(1)
        offsets, words = lists.offsets.to_numpy(), lists.flatten()
        codes = words.dictionary_encode()
        names = codes.dictionary
        rank = np.empty(len(names), np.int64)
        order = pc.sort_indices(names).to_numpy()
        rank[order] = np.arange(len(names))
        sizes = np.diff(offsets)
        owner = np.repeat(np.arange(len(sizes)), sizes)
        key, tf = np.unique(owner * max(1, len(names)) + rank[codes.indices.to_numpy()], return_counts=True)
        row, term = np.divmod(key, max(1, len(names)))
        cut = np.searchsorted(row, np.arange(len(sizes) + 1)).astype(np.int32)
        terms = names.take(pa.array(order[term]))
        first = np.lexsort((term, -tf, row))[cut[:-1][sizes > 0]]
        sign = np.full(len(sizes), None, object)
        sign[sizes > 0] = terms.take(pa.array(first)).to_pylist()
        parts = [pa.ListArray.from_arrays(cut, terms), pa.ListArray.from_arrays(cut, pa.array(tf.astype(np.int32)))]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes.astype(np.int32)), pa.array(sign, pa.string()), *parts], ["idx", "size", "sign", "terms", "tf"])


BLOCKS = (
    "block long, length long, idx array<long>, size array<int>, terms array<string>, held array<int>, most array<int>,"
    " least array<int>, docs array<int>, tf array<int>"
)


def _block(number: int, documents: pa.Table) -> pa.RecordBatch:
    """One row of the index: postings of some documents by term, with the largest count and the least size of each term."""
    size = documents["size"].to_numpy()
    lists = documents["terms"].combine_chunks()
    codes = lists.flatten().dictionary_encode()
    at = np.repeat(np.arange(len(size)), pc.list_value_length(lists).to_numpy())
    tf = documents["tf"].combine_chunks().flatten().to_numpy()
    by_name = pc.sort_indices(codes.dictionary).to_numpy()
    rank = np.empty(len(by_name), np.int64)
    rank[by_name] = np.arange(len(by_name))
    which = rank[codes.indices.to_numpy()]
    order = np.argsort(which, kind="stable")
    which, at, tf = which[order], at[order], tf[order]
    held = np.bincount(which, minlength=len(by_name))
    cut = np.cumsum(held) - held
    most = np.maximum.reduceat(tf, cut) if len(cut) else tf
    least = np.minimum.reduceat(size[at], cut) if len(cut) else at
    one = lambda values: pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)
    lists = [one(pa.array(x.astype(np.int32))) for x in (held, most, least, at, tf)]
    columns = [pa.array([number]), pa.array([int(size.sum())]), one(documents["idx"].combine_chunks()), one(documents["size"].combine_chunks())]
    return pa.RecordBatch.from_arrays([*columns, one(codes.dictionary.take(pa.array(by_name))), *lists], [c.split()[0] for c in BLOCKS.split(", ")])


def _listed(joined: pa.Array) -> pa.ListArray:
    """Terms that were joined by line feeds, which no term holds; the empty text has none."""
    lists = pc.split_pattern(joined, "\n")
    sizes = np.where(pc.equal(joined, "").to_numpy(zero_copy_only=False), 0, pc.list_value_length(lists).to_numpy())
    words = lists.flatten()
    if (sizes == 0).any():
        words = words.filter(pa.array(np.repeat(sizes > 0, np.maximum(sizes, 1))))
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)), words)


def _blocks(documents: int):
    def run(batches):
        number, rest = TaskContext.get().partitionId() << 32, None
        for batch in batches:
            at = batch.schema.get_field_index("terms")
            batch = batch.set_column(at, "terms", _listed(batch.column(at)))
            held = pa.Table.from_batches([*(rest.to_batches() if rest else []), batch]).combine_chunks()
            whole = held.num_rows - held.num_rows % documents
            found = [_block(number + i, held.slice(i * documents, documents)) for i in range(whole // documents)]
            number, rest = number + len(found), held.slice(whole)
            if found:
                yield from pa.Table.from_batches(found).combine_chunks().to_batches()
        if rest is not None and rest.num_rows:
            yield _block(number, rest)

    return run


def block_table(corpus: DataFrame, documents: int = DOCUMENTS) -> DataFrame:
    """Blocks of the documents of a corpus (idx, text); a null text has no tokens. Texts are cut into tokens once.

    Documents are laid out by their most frequent term and their size, so that those of a block share words and
    lengths, which makes its bounds tight. A block keeps what bounds the scores of its documents whatever else the
    index holds: for each term the largest count and the least size of a document with it.
    """
    small_batches(corpus.sparkSession)
    rows = corpus.select(F.col("idx").cast("long").alias("idx"), "text")
    cores = corpus.sparkSession.sparkContext.defaultParallelism
    if rows.rdd.getNumPartitions() < cores:
        rows = rows.repartition(cores)
    counted = rows.select("idx", channel_tokens(F.col("text")).alias("tokens")).mapInArrow(_counted, "idx long, size int, sign string, terms array<string>, tf array<int>")
    return laid_out(work_table(counted, "index-documents"), documents)


def laid_out(counted: DataFrame, documents: int = DOCUMENTS) -> DataFrame:
    """Blocks of documents (idx, size, sign, terms, tf), which are written, as their order is taken from a sample."""
    order = ["sign", "size", "idx"]
    # One string takes half the bytes of an array of short ones in a shuffle.
    joined = counted.withColumn("terms", F.array_join("terms", "\n"))
    return joined.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_blocks(documents), BLOCKS)


def _words(batches):
    """The terms of each batch of blocks once, with the numbers of their documents."""
    for batch in batches:
        words = batch.column(0).flatten().dictionary_encode()
        df = np.bincount(words.indices.to_numpy(), batch.column(1).flatten().to_numpy(), minlength=len(words.dictionary))
        yield pa.RecordBatch.from_arrays([words.dictionary, pa.array(df.astype(np.int64))], ["token", "df"])


def word_table(blocks: DataFrame) -> DataFrame:
    """(token, df) over all blocks; a task adds up what it reads before rows are shuffled."""
    small_batches(blocks.sparkSession)
    return blocks.select("terms", "held").mapInArrow(_words, "token string, df long").groupBy("token").agg(F.sum("df").alias("df"))


def build(corpus: DataFrame) -> dict[str, DataFrame]:
    """The tables of an index of a corpus (idx, text), ready for ``search`` or ``store.install``."""
    blocks = work_table(block_table(corpus), "index-blocks")
    return {"blocks": blocks, "words": work_table(word_table(blocks), "index-words"), "totals": totals(blocks)}


def totals(blocks: DataFrame) -> DataFrame:
    """One row: documents and tokens of the index."""
    return blocks.agg(F.coalesce(F.sum(F.size("idx")), F.lit(0)).cast("long").alias("documents"), F.coalesce(F.sum("length"), F.lit(0)).alias("length"))


def raw_idf(n: int):
    return F.log(F.lit(n) - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)


def stats(words: DataFrame, n: int) -> DataFrame:
    """(token, df, idf) of ``n`` documents: negative idf values become a quarter of the mean idf."""
    raw = words.select("token", "df", raw_idf(n).alias("raw"))
    mean = raw.agg(F.avg("raw").alias("mean"))
    # The mean is a single row.
    return raw.join(F.broadcast(mean)).select("token", "df", F.when(F.col("raw") < 0, EPSILON * F.col("mean")).otherwise(F.col("raw")).alias("idf"))


# --- the search --------------------------------------------------------------------------------


class _Questions:
    """Terms of a block of queries: for each term the queries that hold it and its weight in them."""

    def __init__(self, table: pa.Table, mean: float):
        table = table.sort_by([("token", "ascending"), ("query_id", "ascending")]).combine_chunks()
        self.ids, self.vocabulary = (pc.unique(table[c].combine_chunks()) for c in ("query_id", "token"))
        number = pc.index_in(table["token"].combine_chunks(), value_set=self.vocabulary).to_numpy()
        self.query = pc.index_in(table["query_id"].combine_chunks(), value_set=self.ids).to_numpy().astype(np.int64)
        self.first = np.searchsorted(number, np.arange(len(self.vocabulary) + 1))
        self.weight, self.mean = table["weight"].to_numpy(), mean

    def part(self, tf: np.ndarray, size: np.ndarray) -> np.ndarray:
        return tf * (K1 + 1) / (tf + K1 * (1 - B + B * size / self.mean))

    def rows(self, batch: pa.RecordBatch):
        """For each block: its number in the batch, the places of its terms that are asked for, and those terms' numbers."""
        lists = batch.column(batch.schema.get_field_index("terms"))
        offsets = lists.offsets.to_numpy()
        number = pc.fill_null(pc.index_in(lists.flatten(), value_set=self.vocabulary), -1).to_numpy()
        for i in range(batch.num_rows):
            own = number[offsets[i] - offsets[0] : offsets[i + 1] - offsets[0]]
            places = np.flatnonzero(own >= 0)
            yield i, places, own[places]

    def pairs(self, term: np.ndarray):
        """Every (place among ``term``, query, weight)."""
        n = self.first[term + 1] - self.first[term]
        at = np.repeat(self.first[term] - np.cumsum(n) + n, n) + np.arange(n.sum())
        return np.repeat(np.arange(len(term)), n), self.query[at], self.weight[at]

    def bounds(self, pairs, most: np.ndarray, least: np.ndarray) -> np.ndarray:
        """For each query the highest score that a document of the block can have."""
        place, query, weight = pairs
        part = self.part(most, least)[place]
        # Room for the order of additions and for rounding to six places.
        return np.bincount(query, np.maximum(weight, 0) * part, minlength=len(self.ids)) * (1 + 1e-9) + 1e-6


def _array(batch: pa.RecordBatch, name: str, i: int) -> np.ndarray:
    return batch.column(batch.schema.get_field_index(name))[i].values.to_numpy(zero_copy_only=False)


def _seeds(shared):
    """Blocks with the highest bounds of each query in a task."""

    def run(batches):
        asked, _ = shared.value
        best = Best(len(asked.ids), SEEDS, np.full(len(asked.ids), 1e-5))
        every = np.arange(len(asked.ids))
        for batch in batches:
            block = batch.column(batch.schema.get_field_index("block")).to_numpy()
            for i, places, term in asked.rows(batch):
                bounds = asked.bounds(asked.pairs(term), _array(batch, "most", i)[places], _array(batch, "least", i)[places])
                best.offer(every, bounds, np.full(len(every), block[i]))
        best.merge()
        yield pa.RecordBatch.from_pydict({"query": best.query, "bound": best.score, "block": best.idx})

    return run


def _survivors(shared):
    """(block, queries) of the blocks that may hold a result, and the pairs of term and query in them and in all."""

    def run(batches):
        asked, floor = shared.value
        for batch in batches:
            block = batch.column(batch.schema.get_field_index("block")).to_pylist()
            out = []
            for i, places, term in asked.rows(batch):
                pairs = asked.pairs(term)
                good = asked.bounds(pairs, _array(batch, "most", i)[places], _array(batch, "least", i)[places]) >= floor
                total = np.bincount(pairs[1], minlength=len(floor)) > 0
                out.append((block[i], np.flatnonzero(good & total).astype(np.int32), np.flatnonzero(total & ~good).astype(np.int32)))
            kinds = (pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*out) if out else [[]] * 3, kinds)], ["block", "queries", "left_out"])

    return run


def _scored(shared, k: int, kind: pa.DataType):
    """The ``k`` best documents of each query in a task; blocks are scored for the queries that they name, or that their bounds admit."""

    def run(batches):
        asked, floor = shared.value
        best = Best(len(asked.ids), k, floor)
        for batch in batches:
            named = batch.schema.get_field_index("queries")
            gone = batch.schema.get_field_index("gone")
            for i, places, term in asked.rows(batch):
                place, query, weight = pairs = asked.pairs(term)
                if named >= 0:
                    good = np.zeros(len(asked.ids), bool)
                    good[_array(batch, "queries", i)] = True
                else:
                    good = asked.bounds(pairs, _array(batch, "most", i)[places], _array(batch, "least", i)[places]) >= best.floor
                kept = good[query]
                if not kept.any():
                    continue
                place, query, weight = places[place[kept]], query[kept], weight[kept]
                held, size, idx = (_array(batch, c, i) for c in ("held", "size", "idx"))
                n = held[place]
                at = np.repeat((np.cumsum(held) - held)[place] - np.cumsum(n) + n, n) + np.arange(n.sum())
                doc = _array(batch, "docs", i)[at].astype(np.int64)
                part = asked.part(_array(batch, "tf", i)[at], size[doc])
                cells = np.bincount(doc * len(asked.ids) + np.repeat(query, n), np.repeat(weight, n) * part, minlength=len(idx) * len(asked.ids))
                scores = np.round(cells, 6)
                found = np.flatnonzero(scores > 0)
                doc, query = np.divmod(found, len(asked.ids))
                if gone >= 0 and batch.column(gone)[i].is_valid:
                    there = ~np.isin(idx[doc], _array(batch, "gone", i))
                    doc, query, found = doc[there], query[there], found[there]
                best.offer(query, scores[found], idx[doc])
        best.merge()
        yield pa.RecordBatch.from_pydict({"query_id": asked.ids.take(pa.array(best.query)), "idx": best.idx, "bm25_score": best.score})

    return run


def search(queries: DataFrame, index: dict[str, DataFrame], k: int, block: int = QUERY_BLOCK, skips: list | None = None) -> DataFrame:
    """(query_id, idx, bm25_score, bm25_rank): the ``k`` best positive scores of each query (query_id, text), equal ones by idx.

    Repeated terms of a query count each time. About ``block`` queries are searched for at a time, whose terms are
    broadcast. First the bounds of all blocks name for each query the blocks that may score highest; the
    k-th best score in these is its threshold. Then only blocks whose bound reaches the threshold are scored, by all
    their postings. Postings and scores are never shuffled: a task returns ``k`` rows a query, and what
    a block of queries finds is written before the next one is broadcast. Blocks may have a column ``gone`` with the
    idx of deleted documents. ``skips`` receives (block, queries, left_out) for each block of queries.
    """
    spark = queries.sparkSession
    small_batches(spark)
    kind = queries.schema["query_id"].dataType.simpleString()
    columns = f"query_id {kind}, idx long, bm25_score double"
    order = Window.partitionBy("query_id").orderBy(F.desc("bm25_score"), "idx")
    blocks, words = index["blocks"], index["words"]
    whole = index["totals"].first()
    n, length = whole["documents"], whole["length"]
    parts = []
    if length:
        mean_raw = words.agg(F.avg(raw_idf(n))).first()[0]
        idf = F.when(raw_idf(n) < 0, EPSILON * mean_raw).otherwise(raw_idf(n))
        terms = queries.select("query_id", F.explode(channel_tokens(F.col("text"))).alias("token")).groupBy("query_id", "token").agg(F.count("*").alias("qf"))
        terms = work_table(terms.join(words, "token").select("query_id", "token", (F.col("qf") * idf).alias("weight")), "query-terms")
        size = terms.agg(F.count_distinct("query_id"), F.count("*")).first()
        runs = max(-(-size[0] // block), -(-size[1] // TERM_BLOCK))
        bound = blocks.select("block", "terms", "most", "least")
        for run in range(runs):
            mine = terms if runs == 1 else terms.filter(F.pmod(F.xxhash64("query_id"), F.lit(runs)) == run)
            table = mine.toArrow()
            if not table.num_rows:
                continue
            asked = _Questions(table, length / n)
            none = np.full(len(asked.ids), np.nextafter(0.0, 1.0))
            first = spark.sparkContext.broadcast((asked, none))
            top = Window.partitionBy("query").orderBy(F.desc("bound"), "block")
            seeds = bound.mapInArrow(_seeds(first), "query long, bound double, block long")
            seeds = seeds.withColumn("r", F.row_number().over(top)).filter(F.col("r") <= SEEDS)
            seeds = work_table(seeds.groupBy("block").agg(F.collect_list(F.col("query").cast("int")).alias("queries")), "index-seeds")
            # At most SEEDS rows for each query of the block.
            found = blocks.join(F.broadcast(seeds), "block").mapInArrow(_scored(first, k, None), columns)
            found = found.withColumn("r", F.row_number().over(order)).filter(F.col("r") == k).select("query_id", "bm25_score").toArrow()
            floor = none.copy()
            floor[pc.index_in(found["query_id"].combine_chunks(), value_set=asked.ids).to_numpy()] = found["bm25_score"].to_numpy()
            second = spark.sparkContext.broadcast((asked, floor))
            kept = work_table(bound.mapInArrow(_survivors(second), "block long, queries array<int>, left_out array<int>"), "index-survivors")
            if skips is not None:
                skips.append((pa.array(asked.ids), kept))
            several = kept.filter("size(queries) > 0").select("block", "queries")
            read = blocks.join(several, "block") if several.count() <= FEW * kept.count() else blocks
            parts.append(work_table(read.mapInArrow(_scored(second, k, None), columns), "index-hits"))
            first.unpersist()
            second.unpersist()
    hits = reduce(DataFrame.union, parts) if parts else small_table(spark, columns)
    return hits.withColumn("bm25_rank", F.row_number().over(order)).filter(F.col("bm25_rank") <= k)


def skipped(queries: DataFrame, index: dict[str, DataFrame], k: int) -> DataFrame:
    """(query_id, blocks, scored): for each query the blocks with a term of it, and those whose postings were read."""
    skips: list = []
    search(queries, index, k, skips=skips)
    kind = queries.schema["query_id"].dataType.simpleString()
    parts = []
    for ids, kept in skips:
        both = kept.select(F.explode(F.concat(F.transform("queries", lambda q: F.struct(q.alias("q"), F.lit(1).alias("s"))), F.transform("left_out", lambda q: F.struct(q.alias("q"), F.lit(0).alias("s"))))).alias("x"))
        counted = both.groupBy("x.q").agg(F.count("*").alias("blocks"), F.sum("x.s").alias("scored"))
        names = queries.sparkSession.createDataFrame(pa.table({"q": pa.array(range(len(ids)), pa.int32()), "query_id": ids}))
        parts.append(counted.join(names, "q").select(F.col("query_id").cast(kind).alias("query_id"), "blocks", "scored"))
    return reduce(DataFrame.union, parts) if parts else small_table(queries.sparkSession, f"query_id {kind}, blocks long, scored long")
