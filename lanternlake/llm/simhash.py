"""SimHash groups through pivot distance tables, and groups of texts by the true similarity of their shingles."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .shared import SPACE_SEPARATED, Block, PrefixHash, all_columns, map_texts, materialise, row_key, text_blocks

SHINGLE = 3
SEED = 42
MAX_BITS = 2
#: Reference fingerprints; row i of the distance table holds the distances to all of them.
PIVOTS = 24
#: Members of a bucket that one task compares; larger buckets are cut into pairs of tiles of this size.
TILE = 1024
#: Two fingerprints with at most two differing bits agree in at least two of these four 16-bit bands.
BAND_PAIRS = [(0, 1), (0, 2), (0, 3), (1, 2), (1, 3), (2, 3)]
#: Texts whose sets of runs of so many words have at least this Jaccard similarity are near copies in the pipeline.
NEAR_WORDS, NEAR_SIMILARITY = 5, 0.8
#: Rounds in which texts are compared with two others of each shingle, before what is left is compared in full.
STAR_ROUNDS = 2
#: Shingles that a pair must share in the full comparison, among as many of its first ones as that takes.
SHARED = 3
#: Part of its shared shingles that a pair must show in such a round; it sets which pairs the round compares.
STAR_SEEN = 0.25
#: Share of the texts, at least so many, from which common shingles are known by 32 bits of their hash, and how many of
#: those (12 bytes each) are broadcast; they set an order and lose no pair.
SAMPLE_SHARE, SAMPLE_TEXTS, COMMON_SHINGLES = 0.15, 20_000, 1_000_000


def pivot_fingerprints(count: int = PIVOTS) -> np.ndarray:
    """Fixed random reference fingerprints."""
    return np.random.default_rng(20240917).integers(0, 1 << 64, count, dtype=np.uint64)


def _vote(hashes: np.ndarray) -> int:
    """Fingerprint of the hashes of one text: a bit is set if it is in over half of them."""
    n = len(hashes)
    if not n:
        return 0
    bits = np.unpackbits(hashes.astype(">u8").view(np.uint8).reshape(n, 8), axis=1)
    whole = n // 128 * 128
    ones = bits[whole:].sum(axis=0, dtype=np.int64)
    if whole:
        ones += bits[:whole].reshape(-1, 128, 64).sum(axis=1, dtype=np.uint8).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def fingerprints_of(texts: list[bytes]) -> np.ndarray:
    """Fingerprint of each text (UTF-8), as uint64."""
    out = np.zeros(len(texts), np.uint64)
    block = Block(texts, SPACE_SEPARATED, lower=True)
    raw = block.raw.tobytes()
    digest = xxhash.xxh64_intdigest
    for i in range(len(texts)):
        a, b = block.word_offsets[i], block.word_offsets[i + 1]
        if a == b:
            continue
        starts, ends = block.word_starts[a:b], block.word_ends[a:b]
        if b - a > 1 and (starts[1:] - ends[:-1] != 1).any() or (block.raw[ends[:-1]] != 32).any():
            joined = b" ".join([raw[s:e] for s, e in zip(starts.tolist(), ends.tolist())])
            ends = np.cumsum(ends - starts + 1) - 1
            starts = np.concatenate(([0], ends[:-1] + 1))
        else:
            joined = raw
        width = min(SHINGLE, b - a)
        spans = zip(starts[: len(starts) - width + 1].tolist(), ends[width - 1 :].tolist())
        out[i] = _vote(np.array([digest(joined[s:e], SEED) for s, e in spans], np.uint64))
    return out


def _fingerprint_batches(batches):
    for batch in batches:
        text = batch.column(batch.schema.get_field_index("text"))
        rest = batch.drop_columns(["text"])
        for first, last, texts in text_blocks(text):
            found = fingerprints_of(texts).view(np.int64)
            part = rest.slice(first, last - first)
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(found)], [*part.schema.names, "_fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, content key and fingerprint ``_fp`` (long) of every row; a null or empty text gives zero."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *row_key("doc_id", "text"), "text")
    return map_texts(rows, _fingerprint_batches, "doc_id long, _k1 long, _k2 long, _fp long")


def _popcount(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x)


def linked_stars(left: np.ndarray, right: np.ndarray | None, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A forest over the fingerprints of one tile (or two tiles) with the components of its links.

    The distance table of both sides is computed once; rows of the left side meet the right side in one
    vector step each. A pair goes as soon as a coordinate differs by more than MAX_BITS, and survivors
    are verified by their differing bits.
    """
    both = left if right is None else np.concatenate((left, right))
    first_right = 0 if right is None else len(left)
    table = np.stack([_popcount(both ^ p) for p in pivots]).astype(np.int8)
    order = first_right + np.argsort(table[0, first_right:], kind="stable")
    sorted_first = table[0, order]
    root = np.arange(len(both))
    a_out, b_out = [], []

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for i in range(len(left)):
        near = order[
            np.searchsorted(sorted_first, table[0, i] - MAX_BITS, "left") : np.searchsorted(
                sorted_first, table[0, i] + MAX_BITS, "right"
            )
        ]
        if right is None:
            near = near[near > i]
        for coordinate in table[1:]:
            if not len(near):
                break
            near = near[np.abs(coordinate[near] - coordinate[i]) <= MAX_BITS]
        near = near[_popcount(both[near] ^ both[i]) <= MAX_BITS] if len(near) else near
        for j in near.tolist():
            x, y = find(i), find(j)
            if x != y:
                root[max(x, y)] = min(x, y)
                a_out.append(i)
                b_out.append(j)
    return both[np.array(a_out, int)], both[np.array(b_out, int)]


def _compare(pivots: np.ndarray):
    def run(table: pa.Table) -> pa.Table:
        fp = table.column("_fp").to_numpy().view(np.uint64)
        side = table.column("side").to_numpy()
        left, right = fp[side == 0], fp[side == 1]
        a, b = linked_stars(np.unique(left), np.unique(right) if len(right) else None, pivots)
        return pa.table({"a": a.view(np.int64), "b": b.view(np.int64)})

    return run


def links(distinct: DataFrame, tile: int = TILE) -> DataFrame:
    """Forest edges (a, b) that connect all of ``distinct`` (_fp) at MAX_BITS or fewer differing bits.

    Each fingerprint goes to one bucket per pair of bands. A bucket of at most ``tile`` members is one
    group; a larger one is cut by a hash into tiles, and each pair of tiles is a group of its own, so
    that no group exceeds two tiles and no link is lost.
    """
    band = lambda i: F.shiftrightunsigned("_fp", 16 * i).bitwiseAND(0xFFFF)
    keys = F.array(
        *(F.lit(n).cast("long") * (1 << 32) + band(i) * 65536 + band(j) for n, (i, j) in enumerate(BAND_PAIRS))
    )
    members = distinct.select("_fp", F.explode(keys).alias("bucket"))
    sizes = members.groupBy("bucket").agg(F.count("*").alias("n")).filter("n > 1")
    # A bucket of one has no pair to offer. The row count bounds the tiles of each bucket.
    held = members.join(sizes, "bucket").withColumn("tiles", F.ceil(F.col("n") / tile).cast("int"))
    mine = F.pmod(F.xxhash64("_fp"), F.col("tiles")).cast("int")
    pairs = F.transform(
        F.sequence(F.lit(0), F.col("tiles") - 1),
        lambda other: F.struct(
            F.least("mine", other).alias("lo"),
            F.greatest("mine", other).alias("hi"),
            F.when(F.col("mine") <= other, 0).otherwise(1).alias("side"),
        ),
    )
    dealt = (
        held.withColumn("mine", mine)
        .select("bucket", "_fp", F.explode(pairs).alias("p"))
        .select("bucket", "_fp", "p.lo", "p.hi", "p.side")
    )
    return dealt.groupBy("bucket", "lo", "hi").applyInArrow(_compare(pivot_fingerprints()), "a long, b long").distinct()


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, content key, fingerprint and component_id of every row of ``docs``.

    Rows with one fingerprint are collapsed before the search. Texts without words have fingerprint zero
    and are linked like any other. component_id is the smallest doc_id of the component; null ids are
    ignored in it, and it is null where a component has no id. An empty table gives no rows; repeated rows
    stay and share all values; a very long text is hashed whole; other columns are not read.
    """
    prints = materialise(fingerprints(docs), "fingerprints")
    distinct = materialise(prints.groupBy("_fp").agg(F.min("doc_id").alias("_least")), "distinct-fingerprints")
    return _with_component(prints, distinct, connected_components(materialise(links(distinct), "fingerprint-links")))


def _with_component(prints: DataFrame, distinct: DataFrame, groups: DataFrame) -> DataFrame:
    named = distinct.join(groups.withColumnRenamed("node", "_fp"), "_fp", "left").withColumn(
        "component", F.coalesce("component", "_fp")
    )
    least = named.groupBy("component").agg(F.min("_least").alias("component_id"))
    ids = named.join(least, "component").select("_fp", "component", "component_id")
    return prints.join(ids, "_fp").select("doc_id", "_k1", "_k2", "_fp", "component", "component_id")


def op8(docs: DataFrame) -> DataFrame:
    """The columns of the SimHash contract."""
    return near_duplicates(docs).select("doc_id", F.lpad(F.lower(F.hex("_fp")), 16, "0").alias("fingerprint"), "component_id")


def shingle_sets(texts: list[bytes], width: int) -> list[np.ndarray]:
    """Sorted distinct hashes of the runs of ``width`` words of each text; a shorter text is one run."""
    block = Block(texts, SPACE_SEPARATED, lower=True)
    words = PrefixHash(PrefixHash(block.raw).spans(block.word_starts, block.word_ends))
    out = []
    for a, b in zip(block.word_offsets[:-1].tolist(), block.word_offsets[1:].tolist()):
        run = min(width, b - a)
        starts = np.arange(a, b - run + 1) if run else np.zeros(0, np.int64)
        out.append(np.unique(words.spans(starts, starts + run)))
    return out


def _set_key(hashes: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(hashes.tobytes())


def parity_bits(hashes: np.ndarray) -> np.ndarray:
    """256 bits, each the parity of the hashes that fall on it, as four int64.

    A hash in one of two sets only turns one bit, so the Hamming distance is at most the number of those.
    """
    bits = np.bincount((hashes >> np.uint64(40)).astype(np.int64) & 255, minlength=256) & 1
    return np.packbits(bits.astype(np.uint8)).view(np.int64)


PARITY = [f"b{i}" for i in range(4)]


def _least_common(similarity: float, a: int, b: int) -> int:
    """Shingles that sets of these sizes must share to be that similar."""
    return int(np.ceil(similarity / (1 + similarity) * (a + b) - 1e-9))


def _short(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(32)).astype(np.uint32)


def _all_shingles(width: int):
    def run(batches):
        for batch in batches:
            for _, _, texts in text_blocks(batch.column(0)):
                sets = shingle_sets(texts, width)
                yield pa.RecordBatch.from_arrays([pa.array(_short(np.concatenate(sets)).view(np.int32))], ["s"])

    return run


def _common_shingles(docs: DataFrame, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Short hashes (sorted) and counts of the shingles that several texts of a sample hold."""
    count = docs.count()
    texts = docs.select("text").filter(F.col("text").isNotNull())
    if count > SAMPLE_TEXTS:
        share = max(SAMPLE_SHARE, SAMPLE_TEXTS / count)
        texts = texts.filter(F.pmod(F.xxhash64("text", F.lit(5)), F.lit(1_000_000)) < int(share * 1_000_000))
    held = map_texts(texts.dropDuplicates(["text"]), _all_shingles(width), "s int").groupBy("s").agg(F.count("*").alias("n"))
    found = held.filter("n > 1").orderBy(F.desc("n"), "s").limit(COMMON_SHINGLES).toArrow()
    hashes, counts = found.column("s").to_numpy().view(np.uint32), found.column("n").to_numpy()
    order = np.argsort(hashes)
    return hashes[order], counts[order]


def _prefixes(shared_common, width: int, similarity: float):
    def run(batches):
        common, counts = shared_common.value
        for batch in batches:
            rest = batch.drop_columns(["text"])
            for first, last, texts in text_blocks(batch.column(batch.schema.get_field_index("text"))):
                keys, sizes, prefixes, parity = [], [], [], []
                for hashes in shingle_sets(texts, width):
                    keys.append(_set_key(hashes))
                    sizes.append(len(hashes))
                    parity.append(parity_bits(hashes))
                    rank = np.zeros(len(hashes), np.int64)
                    if len(common):
                        short = _short(hashes)
                        at = np.minimum(np.searchsorted(common, short), len(common) - 1)
                        rank = np.where(common[at] == short, counts[at], 0)
                    length = len(hashes) - int(np.ceil(similarity * len(hashes) - 1e-9)) + 1 if len(hashes) else 0
                    prefixes.append(hashes[np.lexsort((hashes, rank))[:length]].view(np.int64))
                part = rest.slice(first, last - first)
                found = [pa.array(np.array(keys, np.uint64).view(np.int64)), pa.array(sizes, pa.int32()), pa.array(prefixes, pa.list_(pa.int64()))]
                found += [pa.array(x) for x in np.array(parity, np.int64).reshape(-1, 4).T]
                found.append(pa.array(fingerprints_of(texts).view(np.int64)))
                yield pa.RecordBatch.from_arrays([*part.columns, *found], [*part.schema.names, "_fp", "n", "prefix", *PARITY, "print"])

    return run


def _similar(width: int, similarity: float):
    def run(batches):
        for batch in batches:
            a, b = (batch.column(batch.schema.get_field_index(c)) for c in ("text_a", "text_b"))
            keep = []
            for x, y in zip(a, b):
                p, q = shingle_sets([x.as_py(), y.as_py()], width)
                keep.append(len(np.intersect1d(p, q, assume_unique=True)) >= _least_common(similarity, len(p), len(q)))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def _verified(docs: DataFrame, sets: DataFrame, pairs: DataFrame, width: int, similarity: float) -> DataFrame:
    """The pairs (a, b) of sets that are similar by all their shingles; ``sets`` names a row for each set."""
    pairs = materialise(pairs, "near-candidates")
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("_fp")).distinct()
    wanted = materialise(sets.join(wanted, "_fp", "left_semi").select("_fp", "row.*"), "near-candidate-sets")
    texts = docs.select(*row_key("doc_id", "text"), "text").join(wanted, ["_k1", "_k2"]).dropDuplicates(["_fp"])
    texts = materialise(texts.select("_fp", F.coalesce("text", F.lit("")).cast("binary").alias("text")), "near-candidate-texts")
    side = lambda s: texts.select(F.col("_fp").alias(s), F.col("text").alias(f"text_{s}"))
    return map_texts(pairs.join(side("a"), "a").join(side("b"), "b"), _similar(width, similarity), "a long, b long")


def _near_prints(prints: DataFrame) -> DataFrame:
    """Pairs (a, b) of sets ``_fp`` that connect all whose texts have fingerprints ``print`` that op8 links.

    Sets of equal fingerprints meet in the smallest of them, which also stands for its fingerprint in the links to others.
    """
    both = materialise(prints.select("_fp", "print").distinct(), "set-fingerprints")
    heads = materialise(both.groupBy("print").agg(F.min("_fp").alias("head")), "distinct-fingerprints")
    linked = materialise(links(heads.select(F.col("print").alias("_fp"))), "fingerprint-links")
    side = lambda k: heads.select(F.col("print").alias(k), F.col("head").alias(f"set_{k}"))
    pairs = linked.join(side("a"), "a").join(side("b"), "b").select("set_a", "set_b")
    pairs = pairs.union(both.join(heads, "print").select("_fp", "head"))
    return pairs.filter("set_a <> set_b").select(F.least("set_a", "set_b").alias("a"), F.greatest("set_a", "set_b").alias("b")).distinct()


def similar_texts(docs: DataFrame, similarity: float = NEAR_SIMILARITY, width: int = NEAR_WORDS, rounds: int = STAR_ROUNDS) -> DataFrame:
    """Like near_duplicates, with all texts linked whose shingle sets have a Jaccard of ``similarity`` or more.

    Fingerprints link first, as in op8, and an exact check of the sets follows. Near copies may differ in more bits
    than exact bands of fingerprints can part a table by, so what is in different components then is compared by shingles.
    Equal sets are collapsed; texts without words are one set. In any one order of all shingles, two such sets
    share one among the first (1 - similarity) of each, so pairs meet there and none is lost. Rare shingles
    come first. In each of the ``rounds``, the sets of a shingle are compared with one set of its largest
    component and one by chance only; what this leaves in different components is compared in full, so the
    rounds save pairs and lose none. There, pairs meet only on shingles that stand as early in both orders as the
    sizes of the two ask for, and go whose parity bits differ in more places than the shingles of similar sets can. All links are verified on whole texts.
    """
    common = docs.sparkSession.sparkContext.broadcast(_common_shingles(docs, width))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *row_key("doc_id", "text"), "text")
    schema = "doc_id long, _k1 long, _k2 long, _fp long, n int, prefix array<long>, " + ", ".join(f"{b} long" for b in PARITY) + ", print long"
    prints = materialise(map_texts(rows, _prefixes(common, width, similarity), schema), "shingle-prefixes")
    # Rows of one set agree in all that comes from it.
    same = [F.first(c).alias(c) for c in ("n", "prefix", *PARITY)]
    sets = materialise(prints.groupBy("_fp").agg(F.min(F.struct("_k1", "_k2")).alias("row"), F.min("doc_id").alias("_least"), *same), "near-sets")
    members = sets.select("_fp", "n", F.posexplode("prefix").alias("p", "s"))
    several = members.groupBy("s").agg(F.count("*").alias("c")).filter("c > 1").select("s")
    shared = materialise(members.join(several, "s"), "shared-members")

    def near(pairs: DataFrame, seen: float = 1.0) -> DataFrame:
        """Pairs that may be similar, by their sizes and the shingles that they share among the first ones.

        ``seen`` is the part of the shared shingles that ``pairs`` is expected to show.
        """
        rest = lambda n: F.ceil(F.col(n) * similarity - 1e-9) - 1
        need = F.ceil((F.col("na") + F.col("nb")) * (similarity / (1 + similarity)) - 1e-9)
        sizes = F.least("na", "nb") >= F.greatest("na", "nb") * similarity - 1e-9
        counted = pairs.filter(sizes).groupBy("a", "b", "na", "nb").agg(F.count("*").alias("c"))
        return counted.filter(F.col("c") >= (need - F.greatest(rest("na"), rest("nb"))) * seen).select("a", "b")

    def placed(groups: DataFrame) -> DataFrame:
        """The members of the shingles with their components and the sizes of these, written small for a broadcast."""
        sized = groups.join(groups.groupBy("component").agg(F.count("*").alias("size")), "component").withColumnRenamed("node", "_fp")
        found = shared.join(materialise(sized, "near-components"), "_fp", "left").withColumn("component", F.coalesce("component", "_fp"))
        return found.withColumn("size", F.coalesce("size", F.lit(1).cast("long")))

    groups = connected_components(materialise(_verified(docs, sets, _near_prints(prints), width, similarity), "near-links"))
    open_ = placed(groups)
    for turn in range(rounds):
        chance, one = F.xxhash64("_fp", F.lit(turn)), F.struct("component", "_fp", "n")
        heads = open_.groupBy("s").agg(F.max_by(one, F.struct("size", "component", chance)).alias("large"), F.max_by(one, chance).alias("other"))
        star = open_.join(heads, "s").select("_fp", "n", "component", F.explode(F.array("large", "other")).alias("h"))
        star = star.filter("component <> h.component")
        pairs = star.select(F.least("_fp", "h._fp").alias("a"), F.greatest("_fp", "h._fp").alias("b"), F.when(F.col("_fp") < F.col("h._fp"), F.col("n")).otherwise(F.col("h.n")).alias("na"), F.when(F.col("_fp") < F.col("h._fp"), F.col("h.n")).otherwise(F.col("n")).alias("nb"))
        found = materialise(_verified(docs, sets, near(pairs, STAR_SEEN), width, similarity), "near-links")
        # What is connected already costs an edge for each set, not its links.
        groups = connected_components(found.union(groups))
        members = materialise(placed(groups), "near-members")
        mixed = members.groupBy("s").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo < hi").select("s")
        open_ = materialise(members.join(mixed, "s", "left_semi"), "near-open-members")
        if found.isEmpty():
            break
    wide = open_.join(sets.select("_fp", *PARITY), "_fp")
    side = lambda k: wide.select("s", F.col("_fp").alias(k), *(F.col(c).alias(c + k) for c in ("n", "p", "component", *PARITY)))
    # Sets that share as much as they need differ in no more shingles than this, and so in no more bits.
    total = F.col("na") + F.col("nb")
    most = total - 2 * F.ceil(total * (similarity / (1 + similarity)) - 1e-9)
    apart = sum((F.bit_count(F.col(f"b{i}a").bitwiseXOR(F.col(f"b{i}b"))) for i in range(4)), F.lit(0))
    need = F.ceil(total * (similarity / (1 + similarity)) - 1e-9)
    # Sets that share ``need`` shingles share ``least`` of the first n - need + least of either.
    outside = F.ceil(F.greatest("na", "nb") * similarity - 1e-9) - 1
    least = F.greatest(F.lit(1), F.least(F.lit(SHARED), need - outside))
    early = (F.col("pa") < F.col("na") - need + least) & (F.col("pb") < F.col("nb") - need + least)
    sizes = F.least("na", "nb") >= F.greatest("na", "nb") * similarity - 1e-9
    x, y = side("a"), side("b")
    pairs = x.join(y, (x["s"] == y["s"]) & F.expr("a < b and componenta <> componentb") & sizes & early & (apart <= most)).drop(y["s"])
    pairs = pairs.groupBy("a", "b", "na", "nb").agg(F.count("*").alias("c")).filter(F.col("c") >= least).select("a", "b")
    more = materialise(_verified(docs, sets, pairs, width, similarity), "near-links")
    if not more.isEmpty():
        groups = connected_components(more.union(groups))
    return _with_component(prints, sets, groups)


def keep_one(docs: DataFrame, similarity: float = NEAR_SIMILARITY, width: int = NEAR_WORDS) -> DataFrame:
    """The rows of ``docs`` without near duplicates: of each component the row of its smallest doc_id.

    Among rows that share that id, the one with the smallest content key stays, and among rows that share id and text
    the one with the smallest hash of all columns. Rows of a component without any id keep the one with the
    smallest content key. An empty table gives no rows.
    """
    found = similar_texts(docs, similarity, width)
    best = found.groupBy("component_id", F.when(F.col("component_id").isNull(), F.col("component")).alias("_alone")).agg(
        F.min(F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "_k1", "_k2")).alias("best")
    )
    stay = best.select("best._k1", "best._k2")
    order = F.struct(*(F.xxhash64(F.lit(n), *all_columns(docs)) for n in (3, 4)))
    keyed = docs.select(F.struct("*").alias("_row"), order.alias("_order"), *row_key("doc_id", "text"))
    kept = keyed.join(stay, ["_k1", "_k2"], "left_semi").groupBy("_k1", "_k2").agg(F.min_by("_row", "_order").alias("_row"))
    return kept.select("_row.*")
