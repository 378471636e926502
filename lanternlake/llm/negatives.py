"""Hard negatives: rows of another label whose score lies in a window below that of a positive, by vantage-point trees."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .shared import materialise

#: Rows of one tree, and of one of its leaves.
TREE_ROWS, LEAF_ROWS = 8192, 256
#: Anchors whose vectors, and then windows, are broadcast at a time (with 64 components about 0.5 MB and 3 MB).
ANCHOR_BLOCK = 1024
POSITIVES, NEGATIVES = 5, 5
#: A negative scores at least LOW percent of its positive, and no more than it.
LOW, HIGH = 80, 100
#: Rounding moves a distance by at most this part of the length of the lifted vectors; bounds give way by it.
SLACK = 1e-6


def taking_part(rows: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """(vec_id long, label long, v array<long>) of the rows that take part.

    Rows with a null id, label or vector, or with a component that is null or not finite, take no part. Of rows that
    share a vec_id, the one with the smallest (label, v) stays. Other columns are not read.
    """
    x = F.transform(F.col(vector), lambda c: c.cast("double"))
    finite = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    kept = rows.filter(F.col(vec_id).isNotNull() & F.col(label).isNotNull() & F.col(vector).isNotNull() & finite)
    kept = kept.select(
        F.col(vec_id).cast("long").alias("vec_id"),
        F.col(label).cast("long").alias("label"),
        F.transform(x, lambda c: F.floor(c * 256).cast("long")).alias("v"),
    )
    n, ids = kept.select(F.count("*"), F.count_distinct("vec_id")).first()
    return kept if n == ids else kept.groupBy("vec_id").agg(F.min(F.struct("label", "v")).alias("r")).select("vec_id", "r.*")


def _exact(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of integer rows; in floats where these hold them exactly."""
    if not a.size or not b.size:
        return np.zeros((len(a), len(b)), np.int64)
    largest = float(np.abs(a).max()) * float(np.abs(b).max()) * a.shape[1]
    if largest < 2**53:
        return (a.astype(float) @ b.astype(float).T).astype(np.int64)
    return a @ b.T


class Tree:
    """A vantage-point tree over norm-augmented integer vectors, in arrays.

    Each vector gets one more component, which lifts all to the length of the longest; a query gets a zero. The
    squared distance of a query to a row is then |query|² + longest² - 2 score, so a window of scores is an annulus
    of distances. A node halves its rows by their distance to its vantage point; both halves keep their least and
    largest distance, so ties may fall on either side and the tree is balanced for any number of equal rows.
    """

    def __init__(self, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray, leaf: int = LEAF_ROWS):
        norms = (vectors.astype(float) ** 2).sum(axis=1)
        self.longest = norms.max(initial=0.0)
        lift = np.sqrt(self.longest - norms)
        rows = vectors.astype(float)
        parts, nodes = [np.arange(len(ids))], []
        self.bounds: list[tuple[np.ndarray, ...]] = []  # for each level: vantage points, least and largest distances
        while max(map(len, parts)) > leaf:
            halves = []
            for part in parts:
                # A row far from the middle of the part tells its rows apart best.
                point = part[np.argmin(rows[part] @ rows[part].mean(axis=0) + lift[part] * lift[part].mean())]
                square = norms[part] + lift[part] ** 2 + self.longest - 2 * (rows[part] @ rows[point] + lift[part] * lift[point])
                far = np.sqrt(np.maximum(square, 0))
                by = np.argsort(far, kind="stable")
                for own in (by[: len(by) // 2], by[len(by) // 2 :]):
                    nodes.append((point, far[own].min(initial=np.inf), far[own].max(initial=0.0)))
                    halves.append(part[own])
            self.bounds.append(tuple(np.array(x) for x in zip(*nodes)))
            parts, nodes = halves, []
        self.points = [vectors[points] for points, _, _ in self.bounds]
        # Rows of a leaf stand by id, so that the first of equal scores is the one with the smallest id.
        parts = [part[np.argsort(ids[part], kind="stable")] for part in parts]
        self.leaves = [(ids[p], labels[p], vectors[p]) for p in parts]

    def distance(self, norms: np.ndarray, scores: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(norms + self.longest - 2.0 * scores, 0))

    def reach(self, queries: np.ndarray, norms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Least and largest distance at which each leaf can hold rows, for every query."""
        least, most = np.zeros((len(queries), 1)), np.full((len(queries), 1), np.inf)
        for (_, low, high), points in zip(self.bounds, self.points):
            far = self.distance(norms[:, None], _exact(queries, points))
            least = np.maximum(np.repeat(least, 2, axis=1), np.maximum(far - high, low - far))
            most = np.minimum(np.repeat(most, 2, axis=1), far + high)
        return least, most

    def nearest(self, found: Found, queries: np.ndarray, norms: np.ndarray, of: np.ndarray) -> int:
        """Offer ``found`` the rows of its windows, nearest leaves first; returns how many rows were scored.

        ``of`` names the query of each window. A window takes its next leaf as long as the leaf can hold a row in
        the annulus that is no farther than the last of its k best so far; all windows at a leaf are scored at once.
        """
        least, most = self.reach(queries, norms)
        slack = SLACK * np.sqrt(norms + self.longest + 1)
        inner = self.distance(norms[of], found.high) - slack[of]
        outer = self.distance(norms[of], found.low) + slack[of]
        order = np.argsort(least, axis=1, kind="stable")
        scored, active = 0, np.arange(len(of))
        for turn in range(len(self.leaves)):
            leaf = order[of[active], turn]
            kth = self.distance(norms[of[active]], found.worst[active]) + slack[of[active]]
            near = least[of[active], leaf] <= np.minimum(outer[active], kth)
            active, leaf = active[near], leaf[near]
            if not len(active):
                break
            open_ = most[of[active], leaf] >= inner[active]
            for number in np.unique(leaf[open_]):
                windows = active[open_][leaf[open_] == number]
                ids, labels, vectors = self.leaves[number]
                own, at = np.unique(of[windows], return_inverse=True)
                found.offer(windows, ids, labels, _exact(queries[own], vectors)[at])
                scored += len(own) * len(ids)
        return scored


class Found:
    """The k best rows of each window so far: scores from high to low, equal ones by id."""

    def __init__(self, low, high, label, same, skip, k):
        self.low, self.high, self.label, self.same, self.skip, self.k = low, high, label, same, skip, k
        self.worst = low.copy()
        self.rows = np.zeros((0, 3), np.int64)

    def offer(self, windows: np.ndarray, ids: np.ndarray, labels: np.ndarray, scores: np.ndarray) -> None:
        """``scores`` has a row for each of ``windows`` and a column for each of ``ids``."""
        fits = (scores >= self.worst[windows][:, None]) & (scores <= self.high[windows][:, None])
        fits &= ((labels[None, :] == self.label[windows][:, None]) == self.same) & (ids[None, :] != self.skip[windows][:, None])
        at, column = np.nonzero(fits)
        if not len(at):
            return
        new = np.stack([windows[at], ids[column], scores[at, column]], axis=1)
        mine = np.zeros(len(self.low), bool)
        mine[new[:, 0]] = True
        held = mine[self.rows[:, 0]]
        rows = np.concatenate([self.rows[held], new])
        rows = rows[np.lexsort((rows[:, 1], -rows[:, 2], rows[:, 0]))]
        first = np.concatenate(([True], rows[1:, 0] != rows[:-1, 0]))
        place = np.arange(len(rows)) - np.maximum.accumulate(np.where(first, np.arange(len(rows)), 0))
        full = rows[place == self.k - 1]
        self.worst[full[:, 0]] = full[:, 2]
        self.rows = np.concatenate([self.rows[~held], rows[place < self.k]])


def _vectors(column: pa.Array, width: int) -> np.ndarray:
    """Rows of integers, filled with zeros to ``width``."""
    lengths = np.diff(column.offsets.to_numpy())
    values = column.values.to_numpy(zero_copy_only=False)[column.offsets[0].as_py() : column.offsets[-1].as_py()]
    out = np.zeros((len(column), width), np.int64)
    out[np.arange(width)[None, :] < lengths[:, None]] = values
    return out


def _search(shared, width: int, positives: bool, tree_rows: int):
    """Best rows of every window over the trees of one task; bounds carry over from tree to tree."""

    def run(batches):
        window = anchor = norms = None
        held, size = [], 0

        def search(ids, labels, vectors):
            nonlocal window, anchor, norms
            if window is None:
                norms, anchor, window = _windows(shared.value, positives)
            Tree(ids, labels, vectors).nearest(window, anchor, norms, shared.value["of"])

        def flush():
            search(*(np.concatenate(x) for x in zip(*held)))

        for batch in batches:
            columns = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
            held.append((columns["vec_id"].to_numpy(), columns["label"].to_numpy(), _vectors(columns["v"], width)))
            size += batch.num_rows
            if size >= tree_rows:
                flush()
                held, size = [], 0
        if size:
            flush()
        if window is not None and len(window.rows):
            keys = shared.value["keys"][window.rows[:, 0]]
            columns = [*keys.T, window.rows[:, 1], window.rows[:, 2]]
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in columns], [f"c{i}" for i in range(len(columns))])

    return run


def _windows(value: dict, positives: bool):
    vectors = value["vectors"]
    norms = (vectors.astype(float) ** 2).sum(axis=1)
    found = Found(value["low"], value["high"], value["label"], positives, value["skip"], value["k"])
    return norms, vectors, found


def _percent_of(score: np.ndarray, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
    """Least and largest integer score in the window of a positive (empty windows have least > largest)."""
    return -((-low * score) // 100), high * score // 100


def _scan(rows: DataFrame, value: dict, width: int, positives: bool, names: list[str]) -> DataFrame:
    """Candidates of all tasks for one block of windows, written before the broadcast goes."""
    shared = rows.sparkSession.sparkContext.broadcast(value)
    schema = ", ".join(f"c{i} long" for i in range(len(names)))
    found = materialise(rows.mapInArrow(_search(shared, width, positives, TREE_ROWS), schema).toDF(*names), "window-candidates")
    shared.unpersist()
    return found


def _first(rows: DataFrame, keys: list[str], k: int, score: Column, row_id: Column) -> DataFrame:
    by = Window.partitionBy(*keys).orderBy(score.desc(), row_id)
    return rows.withColumn("rank", F.row_number().over(by).cast("int")).filter(F.col("rank") <= k)


def hard_negatives(
    rows: DataFrame, anchors: Column | None = None, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH, block: int = ANCHOR_BLOCK
) -> DataFrame:
    """Hard negatives of the rows that ``anchors`` names (default: vec_id divisible by 100).

    ``rows`` has vec_id, label and v as from ``taking_part``. Every task cuts what it reads into trees of TREE_ROWS
    rows, so every row is indexed and none is shuffled. Anchors go in blocks: one search for the positives (windows
    without a lower end), one for the negatives of all their windows; a task returns at most k rows for a window.
    An empty table, or anchors without positives or without rows in the window, give no rows. Equal scores stand by
    vec_id. Vectors shorter than the longest are filled with zeros. Scores are exact below 2**63.
    """
    spark = rows.sparkSession
    rows = materialise(rows, "vectors")
    anchors = F.col("vec_id") % 100 == 0 if anchors is None else anchors
    chosen = materialise(rows.filter(anchors), "anchors")
    width = rows.agg(F.max(F.size("v"))).first()[0] or 0
    parts, least = [], None
    while True:
        more = chosen if least is None else chosen.filter(F.col("vec_id") > least)
        table = more.orderBy("vec_id").limit(block).toArrow()
        if not table.num_rows:
            break
        ids = table.column("vec_id").combine_chunks().to_numpy()
        least = int(ids[-1])
        label = table.column("label").combine_chunks().to_numpy()
        vectors = _vectors(table.column("v").combine_chunks(), width)
        wide = np.iinfo(np.int64)
        value = {
            "vectors": vectors, "of": np.arange(len(ids)), "label": label, "skip": ids, "k": positives, "keys": ids[:, None],
            "low": np.full(len(ids), wide.min // 4), "high": np.full(len(ids), wide.max // 4),
        }
        found = _scan(rows, value, width, True, ["anchor_id", "positive_id", "positive_score"])
        pairs = _first(found, ["anchor_id"], positives, F.col("positive_score"), F.col("positive_id")).toArrow()
        if pairs.num_rows:
            a, p, s = (pairs.column(c).combine_chunks().to_numpy() for c in ("anchor_id", "positive_id", "positive_score"))
            of = np.searchsorted(ids, a)
            least_score, largest = _percent_of(s, low, high)
            value = {
                "vectors": vectors, "of": of, "label": label[of], "skip": a, "k": negatives, "keys": np.stack([a, p, s], axis=1),
                "low": least_score, "high": largest,
            }
            found = _scan(rows, value, width, False, ["anchor_id", "positive_id", "positive_score", "negative_id", "negative_score"])
            parts.append(_first(found, ["anchor_id", "positive_id"], negatives, F.col("negative_score"), F.col("negative_id")))
        if table.num_rows < block:
            break
    names = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    if not parts:
        return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    out = parts[0]
    for part in parts[1:]:
        out = out.union(part)
    return out.select(*names)


def op11(embeddings: DataFrame) -> DataFrame:
    """The rows of the hard-negative contract; every seventh vec_id first takes the next label."""
    rows = taking_part(embeddings)
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(rows.withColumn("label", label))


OP11_SQL = """
WITH rows AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         [floor(256 * x::DOUBLE) FOR x IN embedding] AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
), scored AS (
  SELECT a.vec_id AS anchor_id, a.label AS anchor_label, o.vec_id AS other_id, o.label AS other_label,
         CAST(list_inner_product(a.v, o.v) AS BIGINT) AS score
  FROM rows a JOIN rows o ON a.vec_id % 100 = 0 AND a.vec_id <> o.vec_id
), positives AS (
  SELECT anchor_id, anchor_label, other_id AS positive_id, score AS positive_score FROM scored WHERE anchor_label = other_label
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5
)
SELECT p.anchor_id, p.positive_id,
       CAST(row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.other_id) AS INTEGER) AS rank,
       s.other_id AS negative_id, p.positive_score, s.score AS negative_score
FROM positives p JOIN scored s ON s.anchor_id = p.anchor_id AND s.other_label <> p.anchor_label
  AND 80 * p.positive_score <= 100 * s.score AND 100 * s.score <= 100 * p.positive_score
QUALIFY rank <= 5
"""
