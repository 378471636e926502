"""Toxicity by multiple-instance learning: sentences scored, combined by noisy-or, trained on documents."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import ALNUM, Block, PrefixHash, byte_class, map_texts, text_blocks

#: Rows that the fit may use: labelled toxic, labelled clean, and the longest text in characters.
MAX_TOXIC = 2500
MAX_CLEAN = 3500
MAX_CHARS = 20_000
THRESHOLD = 0.3
BUCKETS = 1 << 20
#: A word stands for itself and its beginnings of so many bytes, so that inflected forms share weights.
PREFIXES = (4, 5, 6)
#: Share of the sample that only calibrates.
CALIBRATION = 0.25
#: Chance of a toxic document without any toxic sentence; keeps empty texts defined.
LEAK = 1e-4
#: A feature takes part when the share of documents with it differs between the labels by so many standard errors.
MIN_EVIDENCE = 4.5
#: Words after which a sentence without an end is cut.
MAX_SENTENCE = 24
SENTENCE_END = byte_class(b".!?\n")


class Sentences:
    """Hashed features of the words of some texts, grouped by sentence and by text."""

    def __init__(self, texts: list[bytes]):
        block = Block(texts, ALNUM, lower=True)
        hashes = PrefixHash(block.raw)
        starts, ends = block.word_starts, block.word_ends
        self.n_texts = len(texts)
        if not len(starts):
            self.features = np.zeros((0, 1 + len(PREFIXES)), np.int64)
            self.first = self.text = np.zeros(0, np.int64)
            self.spans = lambda rows: []
            return
        mask = np.uint64(BUCKETS - 1)
        columns = [hashes.spans(starts, ends)]
        columns += [hashes.spans(starts, np.minimum(starts + n, ends)) + np.uint64(n) for n in PREFIXES]
        self.features = np.stack([(c & mask).astype(np.int32) for c in columns], axis=1)
        stops = np.cumsum(SENTENCE_END[block.raw])[starts]
        #: First word of each sentence, and the text of each sentence.
        begins = np.concatenate(([True], np.diff(stops) > 0))
        within = np.arange(len(starts)) - np.maximum.accumulate(np.where(begins, np.arange(len(starts)), 0))
        self.first = np.flatnonzero(within % MAX_SENTENCE == 0)
        self.text = block.word_text()[self.first]
        last = np.append(self.first[1:], len(starts)) - 1

        def spans(rows):
            chars = np.concatenate(([0], np.cumsum((block.raw & 0xC0) != 0x80)))
            base = chars[block.starts[self.text[rows]]]
            return list(zip((chars[starts[self.first[rows]]] - base).tolist(), (chars[ends[last[rows]]] - base).tolist()))

        self.spans = spans

    def logits(self, weights: np.ndarray, bias: float) -> np.ndarray:
        if not len(self.first):
            return np.zeros(0)
        words = weights[self.features].sum(axis=1, dtype=np.float64)
        return np.clip(np.add.reduceat(words, self.first) + bias, -30, 10)


def _log_clean(z: np.ndarray, text: np.ndarray, n: int) -> np.ndarray:
    """Log of the chance that no sentence of each text is toxic, with the leak."""
    return -np.bincount(text, np.logaddexp(0, z), n) + np.log1p(-LEAK)


def _logit_of_clean(log_clean: np.ndarray) -> np.ndarray:
    return np.clip(np.log(-np.expm1(log_clean)) - log_clean, -10, 10)


class Model:
    """Sentence weights and the calibration of the document score."""

    def __init__(self, weights: np.ndarray, bias: float, slope: float, shift: float):
        self.weights, self.bias, self.slope, self.shift = weights, bias, slope, shift

    def score(self, sentences: Sentences) -> tuple[np.ndarray, np.ndarray]:
        """Score of each text, and of each sentence."""
        z = sentences.logits(self.weights, self.bias)
        log_clean = _log_clean(z, sentences.text, sentences.n_texts)
        calibrated = self.slope * _logit_of_clean(log_clean) + self.shift
        return 1 / (1 + np.exp(-np.clip(calibrated, -60, 60))), 1 / (1 + np.exp(-np.clip(z, -60, 60)))


def _platt(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and shift of a weighted logistic fit in one variable, with smoothed targets.

    Smoothing (Platt 1999) keeps the fit finite where the labels are separable; steps that do not lower
    the loss are halved.
    """
    toxic = y > 0
    target = np.where(toxic, (toxic.sum() + 1) / (toxic.sum() + 2), 1 / ((~toxic).sum() + 2))
    centre, scale = x.mean(), max(1e-6, x.std())
    u = (x - centre) / scale

    def loss(v):
        z = v[0] * u + v[1]
        return (weight * (np.logaddexp(0, z) - target * z)).sum()

    v = np.array([1.0, 0.0])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(v[0] * u + v[1], -60, 60)))
        g = np.array([(weight * (p - target) * u).sum(), (weight * (p - target)).sum()])
        c = weight * p * (1 - p)
        h = np.array([[(c * u * u).sum() + 1e-6, (c * u).sum()], [(c * u).sum(), c.sum() + 1e-6]])
        step, now = np.linalg.solve(h, g), loss(v)
        while loss(v - step) > now and np.abs(step).max() > 1e-9:
            step = step / 2
        v = v - step
        if np.abs(step).max() < 1e-7:
            break
    slope = v[0] / scale
    return (slope, v[1] - slope * centre) if slope > 0 else (1.0, 0.0)


def evidence(prepared: list[tuple[Sentences, np.ndarray]]) -> np.ndarray:
    """Starting weights: half the log-odds of a feature between the labels, 0 without enough evidence."""
    counts, totals = np.zeros((2, BUCKETS)), np.zeros(2)
    for s, y in prepared:
        owner = np.repeat(s.text, np.diff(np.append(s.first, len(s.features))))
        pairs = np.unique(s.features.astype(np.int64) + owner[:, None] * BUCKETS)
        label = y[pairs // BUCKETS].astype(int)
        for k in (0, 1):
            counts[k] += np.bincount(pairs[label == k] % BUCKETS, minlength=BUCKETS)
            totals[k] += (y == k).sum()
    share = counts / totals[:, None]
    pooled = counts.sum(axis=0) / totals.sum()
    error = np.sqrt(np.maximum(pooled * (1 - pooled), 1e-12) * (1 / totals).sum())
    strong = (np.abs(share[1] - share[0]) >= MIN_EVIDENCE * error) & (counts.sum(axis=0) >= 3)
    odds = np.log((counts[1] + 0.5) / (totals[1] + 1)) - np.log((counts[0] + 0.5) / (totals[0] + 1))
    return np.where(strong, 0.5 * odds, 0).astype(np.float32)


def train(texts: list[bytes], labels: np.ndarray, prior: float, epochs: int = 10, seed: int = 1) -> Model:
    """Fit on documents and their labels; ``prior`` is the share of toxic documents in the corpus.

    Gradients of the noisy-or pass to the sentences of a toxic document in proportion to their own
    scores, so that the sentences that explain the label gain weight and the rest stay clean.
    """
    weights = np.zeros(BUCKETS, np.float32)
    if not len(texts) or labels.min() == labels.max():
        base = np.clip(prior, 1e-6, 1 - 1e-6)
        return Model(weights, -30.0, 0.0, float(np.log(base / (1 - base))))
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(texts))
    cut = max(1, int(len(order) * CALIBRATION)) if len(order) >= 40 else 0
    fit = order[cut:]
    size = 128
    batches = [fit[i : i + size] for i in range(0, len(fit), size)]
    prepared = [(Sentences([texts[i] for i in b]), labels[b].astype(float)) for b in batches]
    weights = evidence(prepared)
    chosen = weights != 0
    n_sentences = sum(len(p.first) for p, _ in prepared) / max(1, len(fit))
    bias, squares, bias_squares = -float(np.log(20 * (1 + n_sentences))), np.full(BUCKETS, 1e-3, np.float32), 1e-3
    for _ in range(epochs):
        for k in rng.permutation(len(prepared)).tolist():
            s, y = prepared[k]
            z = s.logits(weights, bias)
            log_clean = _log_clean(z, s.text, s.n_texts)
            toxic = np.maximum(-np.expm1(log_clean), 1e-9)
            pull = np.where(y > 0, -np.exp(log_clean) / toxic, 1.0)
            slope = pull[s.text] / (1 + np.exp(-np.clip(z, -60, 60))) / s.n_texts
            lengths = np.diff(np.append(s.first, len(s.features)))
            by_word = np.repeat(slope, lengths)
            g = np.zeros(BUCKETS)
            for column in s.features.T:
                g += np.bincount(column, by_word, BUCKETS)
            touched = np.flatnonzero(chosen & (g != 0))
            g = (g[touched] + 2e-5 * weights[touched]).astype(np.float32)
            squares[touched] += g * g
            weights[touched] -= 0.25 * g / np.sqrt(squares[touched])
            total = slope.sum()
            bias_squares += total * total
            bias = min(-2.0, bias - 0.1 * total / np.sqrt(bias_squares))
    raw = Model(weights, bias, 1.0, 0.0)
    held = order[:cut] if cut else order
    s = Sentences([texts[i] for i in held])
    x = _logit_of_clean(_log_clean(s.logits(weights, bias), s.text, s.n_texts))
    y = labels[held].astype(float)
    if 0 < y.mean() < 1:
        weight = np.where(y > 0, prior / y.mean(), (1 - prior) / (1 - y.mean()))
        raw.slope, raw.shift = _platt(x, y, weight)
    return raw


def held_out(doc_id) -> F.Column:
    """crc32 of the id as text, modulo 4, is 2; false for a null id."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("long").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, max_toxic: int = MAX_TOXIC, max_clean: int = MAX_CLEAN) -> Model:
    """Train on at most ``max_toxic`` + ``max_clean`` labelled rows of at most MAX_CHARS characters.

    Rows are chosen by a hash of their id; held-out ids, null ids and null labels are never used. A text
    that several ids share is one example. Labels that disagree, of an id or of such a text, count as
    toxic. Reruns train the same model.
    """
    known = (
        labels.filter("doc_id is not null and toxic is not null")
        .filter(~held_out("doc_id"))
        .groupBy(F.col("doc_id").cast("long").alias("doc_id"))
        .agg((F.max("toxic") > 0).alias("toxic"))
    )
    share = known.agg(F.avg(F.col("toxic").cast("int"))).first()[0]
    if share is None:
        return train([], np.zeros(0), 0.0)
    take = lambda toxic, n: known.filter(F.col("toxic") == toxic).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n)
    sample = take(True, max_toxic).union(take(False, max_clean))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").filter(F.length("text") <= MAX_CHARS)
    # The sample is bounded by its two limits. Documents that share an id and a text count once.
    rows = texts.join(F.broadcast(sample), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.first("toxic").alias("toxic"))
    rows = rows.groupBy("text").agg(F.min("doc_id").alias("doc_id"), F.max("toxic").alias("toxic"))
    found = sorted(rows.collect(), key=lambda r: r["doc_id"])
    return train([r["text"].encode() for r in found], np.array([r["toxic"] for r in found], bool), float(share))


def _score(shared_model, threshold: float):
    def run(batches):
        model = shared_model.value
        for batch in batches:
            text = batch.column(batch.schema.get_field_index("text"))
            rest = batch.drop_columns(["text"])
            for first, last, texts in text_blocks(text):
                sentences = Sentences(texts)
                score, by_sentence = model.score(sentences)
                located = [[] for _ in texts]
                rows = np.flatnonzero((by_sentence >= 0.5) & (score[sentences.text] >= threshold)) if len(by_sentence) else []
                for row, (a, b) in zip(rows, sentences.spans(rows) if len(rows) else ()):
                    located[sentences.text[row]].append({"start": a, "end": b, "score": float(by_sentence[row])})
                part = rest.slice(first, last - first)
                kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array(score), pa.array(located, kind)], [*part.schema.names, "score", "offending"]
                )

    return run


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted and the offending sentences of every row of ``docs``.

    Scores use the text only. Offending sentences (code point spans with their own scores) are located
    in documents predicted toxic. A null text is empty and gets the score of no sentence; without usable
    labels all scores are the share of toxic labels, or 0. Repeated rows get equal scores; an empty table
    gives no rows; a very long text is scored whole. Nothing is shuffled to score.
    """
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out("doc_id").alias("held_out"), "text")
    schema = "doc_id long, held_out boolean, score double, offending array<struct<start:bigint,end:bigint,score:double>>"
    scored = map_texts(rows, _score(model, threshold), schema)
    return scored.select(
        "doc_id", "held_out", "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "offending"
    )


def op10(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The columns of the toxicity contract."""
    return toxicity(docs, labels).drop("offending")
