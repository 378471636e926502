"""Secret scan: fixed patterns, and a character convolutional network over every other candidate."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import LOWER, Block, byte_class, map_texts, materialise, text_blocks, with_text

# Fixed patterns of the contract, on UTF-8 bytes, where letters without case are ASCII only.
KINDS = ("assign", "access", "hex", "learned")
KEYWORDS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
ASSIGN = re.compile(
    rb"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
ACCESS = re.compile(rb"AKIA[A-Z0-9]{16,}")
HEX = re.compile(rb"[0-9a-f]{24,}")

TOKEN_BYTES = byte_class(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.=-")
#: A candidate is what base spans leave of a run of token characters, of this length or more.
MIN_CANDIDATE = 8
#: Bytes that the network sees before a candidate, after it, and of it (in this order in a window); a longer
#: candidate is seen in overlapping pieces, and its score is the highest of them.
BEFORE, AFTER, WITHIN = 16, 8, 40
INSIDE = BEFORE + AFTER
STRIDE = 20
#: Documents that findings are taken from to learn, and findings of each label.
SAMPLE_DOCS = 20_000
SAMPLE_FINDINGS = 4_000
#: The threshold keeps at least this share of the labelled secrets of the calibration part.
MIN_RECALL = 0.95
FILTERS, WIDTH, SYMBOLS = 16, 5, 100

UPPER, LOWERED, DIGITS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"
#: Shapes of planted secrets: parts of (prefix, alphabet, shortest, longest); a part is a prefix and random characters.
SHAPES = {
    "base64": [("", UPPER + LOWERED + DIGITS + "+/", 20, 64)],
    "mixed": [("", UPPER + LOWERED + DIGITS, 12, 40)],
    "letters": [("", UPPER + LOWERED, 20, 40)],
    "short hex": [("", DIGITS + "abcdef", 16, 23)],
    "upper hex": [("", DIGITS + "ABCDEF", 20, 64)],
    "upper": [("", UPPER + DIGITS, 16, 32)],
    "lower": [("", LOWERED + DIGITS, 16, 40)],
    "prefixed": [("pk_test_", UPPER + LOWERED + DIGITS, 16, 32)],
    "three parts": [("eyJ", UPPER + LOWERED + DIGITS + "-_", 16, 40), (".eyJ", UPPER + LOWERED + DIGITS + "-_", 20, 80), (".", UPPER + LOWERED + DIGITS + "-_", 30, 43)],
    "dashed": [("", UPPER + LOWERED + DIGITS, 6, 12), ("-", UPPER + LOWERED + DIGITS, 6, 12), ("-", UPPER + LOWERED + DIGITS, 6, 12)],
}
#: What may stand before a planted secret; mostly it is the text of the corpus.
LEADS = ("key=", "key: ", "pwd: ", "auth=", "credential: ", "Bearer ", "private_key=", "signature: ")


#: What is no secret though it is no word: numbers, dates and joined words ("{}" stands for one).
DECOYS = ("#" * 8, "#" * 12, "#" * 16, "#" * 20, "####-##-##", "##.##.####", "###-###-####", "{}-{}", "{}.{}", "{}_{}", "{}/{}/{}", "{}.{}.com", "{}##", "{}={}")


def plant(rng: np.random.Generator, shapes: dict = SHAPES) -> bytes:
    """A random secret of one of the shapes."""
    parts = shapes[sorted(shapes)[rng.integers(len(shapes))]]
    drawn = (prefix + "".join(rng.choice(list(alphabet), rng.integers(least, most + 1))) for prefix, alphabet, least, most in parts)
    return "".join(drawn).encode()


def _symbols() -> np.ndarray:
    """Symbol of each byte: 1 to 95 for printable ASCII, 96 for white space, 97 for control, 98 for others."""
    table = np.full(256, 98, np.int64)
    table[:0x20] = 97
    table[[9, 10, 11, 12, 13]] = 96
    table[0x20:0x7F] = np.arange(1, 96)
    return table


SYMBOL_OF = _symbols()
#: Symbols of the same characters in upper case.
SHOUTED = np.arange(SYMBOLS)
SHOUTED[SYMBOL_OF[0x61:0x7B]] = SYMBOL_OF[0x41:0x5B]


class Network:
    """One convolution with max pooling and a logistic output, over byte symbols."""

    def __init__(self, seed: int = 0):
        rng = np.random.default_rng(seed)
        self.filters = rng.normal(0, 0.2, (WIDTH, SYMBOLS, FILTERS)).astype(np.float32)
        self.offset = np.zeros(FILTERS, np.float32)
        self.output = rng.normal(0, 0.3, FILTERS)
        self.bias = 0.0
        self.slope, self.shift, self.threshold = 1.0, 0.0, 1.1
        #: Recall on the labelled secrets of the calibration part, and the share of its others above the threshold.
        self.recall = self.false_share = 0.0

    def _pool(self, windows: np.ndarray):
        steps = windows.shape[1] - WIDTH + 1
        total = np.take(self.filters[0], windows[:, :steps], axis=0, mode="clip")
        for k in range(1, WIDTH):
            total += np.take(self.filters[k], windows[:, k : k + steps], axis=0, mode="clip")
        total += self.offset
        return total

    def logit(self, windows: np.ndarray) -> np.ndarray:
        out = np.zeros(len(windows))
        # Short candidates first; columns that are empty for all of a batch, but for one filter's width, change nothing.
        used = (windows[:, INSIDE:] > 0).sum(axis=1)
        order = np.argsort(used, kind="stable")
        for i in range(0, len(order), 512):
            rows = order[i : i + 512]
            seen = windows[rows, : INSIDE + used[rows[-1]] + WIDTH].astype(np.intp)
            out[rows] = np.maximum(self._pool(seen).max(axis=1), 0) @ self.output + self.bias
        return out

    def probability(self, windows: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.logit(windows) + self.shift, -50, 50)))

    def train(self, windows: np.ndarray, y: np.ndarray, seed: int = 0) -> None:
        """Adam on the logistic loss; most secrets are seen behind the text that stands before others."""
        rng = np.random.default_rng(seed)
        weights = {"filters": self.filters, "offset": self.offset, "output": self.output, "bias": np.array([self.bias])}
        moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in weights.items()}
        turn, clean = 0, np.flatnonzero(y == 0)
        which = np.arange(FILTERS)[None, :]
        for _ in range(min(40, max(8, 48_000 // len(y)))):
            order = rng.permutation(len(y))
            for i in range(0, len(order), 64):
                rows = order[i : i + 64]
                x, t = windows[rows].copy(), y[rows]
                strange = (t > 0) & (rng.random(len(rows)) < 0.6)
                x[strange, :BEFORE] = windows[rng.choice(clean, strange.sum()), :BEFORE]
                total = self._pool(x)
                at = total.argmax(axis=1)
                pooled = np.maximum(np.take_along_axis(total, at[:, None], 1)[:, 0], 0)
                self.bias = float(weights["bias"][0])
                slope = (1 / (1 + np.exp(-np.clip(pooled @ self.output + self.bias, -50, 50))) - t) / len(rows)
                back = slope[:, None] * self.output * (pooled > 0)
                g = {"filters": np.zeros_like(self.filters), "offset": back.sum(axis=0), "output": slope @ pooled, "bias": np.array([slope.sum()])}
                for k in range(WIDTH):
                    np.add.at(g["filters"][k], (np.take_along_axis(x, at + k, 1), which), back)
                turn += 1
                for name, w in weights.items():
                    m, v = moments[name]
                    m += 0.1 * (g[name] - m)
                    v += 0.001 * (g[name] ** 2 - v)
                    w -= 0.01 * (m / (1 - 0.9**turn)) / (np.sqrt(v / (1 - 0.999**turn)) + 1e-8)
        self.bias = float(weights["bias"][0])

    def calibrate(self, windows: np.ndarray, y: np.ndarray, min_recall: float = MIN_RECALL) -> None:
        """Logistic calibration on unseen findings, and the highest threshold with enough recall on them."""
        x = self.logit(windows)
        target = np.where(y > 0, (y.sum() + 1) / (y.sum() + 2), 1 / ((y == 0).sum() + 2))
        a, b = 1.0, 0.0
        for _ in range(200):
            p = 1 / (1 + np.exp(-np.clip(a * x + b, -50, 50)))
            scale = max(1.0, np.abs(x).max()) ** 2
            a, b = a - ((p - target) * x).mean() / scale * 4, b - (p - target).mean() * 4 / max(1.0, np.abs(x).max())
        self.slope, self.shift = max(a, 1e-3), b
        p = self.probability(windows)
        self.threshold = float(np.quantile(p[y > 0], 1 - min_recall, method="lower"))
        self.recall, self.false_share = float((p[y > 0] >= self.threshold).mean()), float((p[y == 0] >= self.threshold).mean())


class Findings:
    """Base spans and further candidates of some texts.

    ``base`` lists (start, end, kind) by text in bytes of that text; ``starts`` and ``ends`` of the
    candidates are positions in the joined texts.
    """

    def __init__(self, texts: list[bytes]):
        block = Block(texts, TOKEN_BYTES)
        self.block, self.texts = block, texts
        self.base: dict[int, list[tuple[int, int, int]]] = {}
        lowered = LOWER[block.raw].tobytes()
        keyed = set()
        for word in KEYWORDS:
            at = lowered.find(word)
            while at >= 0:
                text = int(np.searchsorted(block.starts, at, "right")) - 1
                keyed.add(text)
                at = lowered.find(word, int(block.ends[text]))
        for i in keyed:
            for m in ASSIGN.finditer(texts[i]):
                if m.end(2) - m.start(2) >= 6:
                    self.base.setdefault(i, []).append((m.start(), m.end(), 0))
        long = np.flatnonzero(block.word_ends - block.word_starts >= 20)
        starts, ends = block.word_starts[long], block.word_ends[long]
        owners = np.searchsorted(block.starts, starts, "right") - 1
        raw = block.raw.tobytes()
        for i, s, e in zip(owners.tolist(), starts.tolist(), ends.tolist()):
            base = int(block.starts[i])
            for pattern, kind in ((ACCESS, 1), (HEX, 2)):
                for m in pattern.finditer(raw, s, e):
                    self.base.setdefault(i, []).append((m.start() - base, m.end() - base, kind))
        open_ = TOKEN_BYTES[block.raw]
        for i, spans in self.base.items():
            spans.sort()
            for a, b, _ in spans:
                open_[block.starts[i] + a : block.starts[i] + b] = False
        edges = np.flatnonzero(np.diff(np.concatenate(([False], open_, [False])).view(np.int8)))
        starts, ends = edges[::2], edges[1::2]
        # A full stop at either end belongs to the sentence.
        ends = ends - (block.raw[ends - 1] == 0x2E)
        starts = starts + (block.raw[starts] == 0x2E)
        long = ends - starts >= MIN_CANDIDATE
        self.starts, self.ends = starts[long], ends[long]

    def owner(self, starts: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.block.starts, starts, "right") - 1

    def windows(self, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Symbols around each piece of the spans, 0 where there is nothing, and the first piece of each span."""
        pieces = 1 + np.maximum(0, -(-(ends - starts - WITHIN) // STRIDE))
        first = np.cumsum(pieces) - pieces
        nth = np.arange(pieces.sum()) - np.repeat(first, pieces)
        last = np.repeat(ends, pieces)
        begin = np.minimum(np.repeat(starts, pieces) + nth * STRIDE, np.maximum(np.repeat(starts, pieces), last - WITHIN))
        end = np.minimum(begin + WITHIN, last)
        text = self.owner(begin)
        out = np.zeros((len(begin), BEFORE + WITHIN + AFTER), np.uint8)
        raw, top = self.block.raw, len(self.block.raw) - 1
        for column, at, low, high in (
            (0, begin[:, None] + np.arange(-BEFORE, 0), self.block.starts[text], begin),
            (BEFORE, end[:, None] + np.arange(AFTER), end, self.block.ends[text]),
            (INSIDE, begin[:, None] + np.arange(WITHIN), begin, end),
        ):
            seen = SYMBOL_OF[raw[np.clip(at, 0, top)]]
            seen[(at < low[:, None]) | (at >= high[:, None])] = 0
            out[:, column : column + at.shape[1]] = seen
        return out, first

    def sure(self, network: Network) -> list[tuple[int, int, int]]:
        """(text, start, end) of the candidates that the network takes for secrets."""
        found = []
        for i in range(0, len(self.starts), 4096):
            starts, ends = self.starts[i : i + 4096], self.ends[i : i + 4096]
            windows, first = self.windows(starts, ends)
            score = np.maximum.reduceat(network.probability(windows), first)
            for row in np.flatnonzero(score >= network.threshold).tolist():
                text = int(self.owner(starts[row : row + 1])[0])
                base = int(self.block.starts[text])
                found.append((text, int(starts[row]) - base, int(ends[row]) - base))
        return found

    def secrets(self) -> tuple[np.ndarray, np.ndarray]:
        """Starts and ends of the base spans in the joined texts; an assignment stands for its value."""
        out = []
        for i, spans in sorted(self.base.items()):
            base = int(self.block.starts[i])
            for a, b, kind in spans:
                out.append((base + (ASSIGN.match(self.texts[i], a).start(2) if kind == 0 else a), base + b))
        pairs = np.array(out, np.int64).reshape(-1, 2)
        return pairs[:, 0], pairs[:, 1]


def _labelled(most: int):
    def run(batches):
        for batch in batches:
            for _, _, texts in text_blocks(batch.column(0)):
                found = Findings(texts)
                for secret, (starts, ends) in ((True, found.secrets()), (False, (found.starts, found.ends))):
                    windows = np.unique(found.windows(starts, ends)[0], axis=0)
                    order = np.array([xxhash.xxh64_intdigest(w.tobytes()) for w in windows], np.uint64)
                    # The smallest hashes of all blocks are among the smallest of each.
                    chosen = np.argsort(order)[:most]
                    raw = [windows[i].tobytes() for i in chosen]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([secret] * len(raw), pa.bool_()), pa.array(order[chosen].view(np.int64)), pa.array(raw, pa.binary())],
                        ["secret", "turn", "window"],
                    )

    return run


def _write(row: np.ndarray, at: int, raw: bytes) -> None:
    row[at : at + len(raw)] = SYMBOL_OF[np.frombuffer(raw, np.uint8)]


def _inside(row: np.ndarray, raw: bytes) -> None:
    """Put ``raw`` in place of the candidate of a window."""
    row[INSIDE:] = 0
    _write(row, INSIDE, raw[:WITHIN])
    if len(raw) > WITHIN:
        _write(row, BEFORE, raw[WITHIN : WITHIN + AFTER])


def planted(contexts: np.ndarray, rng: np.random.Generator, shapes: dict = SHAPES) -> np.ndarray:
    """The windows ``contexts`` with a random secret in place of each candidate, some behind a lead."""
    out = contexts.copy()
    for row in out:
        _inside(row, plant(rng, shapes))
        if rng.random() < 0.25:
            lead = LEADS[rng.integers(len(LEADS))].encode()[-BEFORE:]
            _write(row, BEFORE - len(lead), lead)
    return out


def _word(row: np.ndarray) -> bytes:
    """The candidate of a window, as far as it is seen."""
    symbols = row[INSIDE:][row[INSIDE:] > 0]
    return bytes((symbols[symbols < 96] + 31).astype(np.uint8))


def decoys(contexts: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """The windows ``contexts`` made harder: a secret beside the candidate, a decoy in place of it, or upper case."""
    out = contexts.copy()
    for i, row in enumerate(out):
        if i % 3 == 0:
            row[:] = SHOUTED[row]
        elif i % 3 == 1:
            near = plant(rng)[-12:] + b"\"' ,;|)"[rng.integers(6) :][:1] + b" "
            if rng.random() < 0.8:
                _write(row, BEFORE - len(near), near)
            else:
                _write(row, BEFORE, b" =" + near[: AFTER - 2])
        else:
            parts = DECOYS[rng.integers(len(DECOYS))].split("{}")
            words = [_word(contexts[k]).decode() for k in rng.integers(len(contexts), size=len(parts) - 1)]
            text = "".join(p + w for p, w in zip(parts, [*words, ""]))
            _inside(row, "".join(str(rng.integers(10)) if c == "#" else c for c in text).encode())
    return out


def _fit(secrets: np.ndarray, others: np.ndarray, held: np.ndarray, seed: int) -> Network:
    """Train on the part of both that ``held`` (of the others) does not mark, calibrate on the rest."""
    rng = np.random.default_rng(seed)
    network = Network(seed)
    # A context and what is planted in it fall into the same part.
    windows = np.concatenate((secrets, planted(others, rng), others, decoys(others, rng))).astype(np.int64)
    y = np.repeat([1.0, 0.0], [len(secrets) + len(others), 2 * len(others)])
    held = np.concatenate((np.arange(len(secrets)) % 4 == 0, held, held, held))
    network.train(windows[~held], y[~held])
    network.calibrate(windows[held], y[held])
    return network


def fit(secrets: np.ndarray, others: np.ndarray, seed: int = 0) -> Network:
    """Train on windows of known secrets, windows of corpus candidates, and secrets and decoys planted among those.

    Corpus candidates are unlabelled: each half is judged by a fit on the other half, and those that it
    takes for secrets take no part in the last fit. A quarter of the findings calibrates only.
    """
    if len(others) < 8:
        return Network(seed)
    half = np.arange(len(others)) % 2 == 0
    judged = [_fit(secrets, others, half == k, seed).probability(others) for k in (False, True)]
    clean = np.where(half, judged[1], judged[0]) < 0.5
    others = others[clean]
    return _fit(secrets, others, np.arange(len(others)) % 4 == 0, seed)


def learn(docs: DataFrame, sample_docs: int = SAMPLE_DOCS, sample_findings: int = SAMPLE_FINDINGS) -> Network:
    """Train on findings of about ``sample_docs`` documents, chosen by a hash of their text.

    Labelled secrets are the matches of the fixed patterns and secrets of SHAPES planted into the
    contexts of other candidates; see ``fit``. At most ``sample_findings`` distinct windows of each
    label, in the order of a hash, reach the driver. With fewer than eight candidates nothing is added.
    """
    count = docs.count()
    texts = docs.select("text").filter(F.col("text").isNotNull())
    if count > sample_docs:
        share = int(sample_docs / count * 1_000_000)
        texts = texts.filter(F.pmod(F.xxhash64("text", F.lit(3)), F.lit(1_000_000)) < share)
    rows = materialise(map_texts(texts, _labelled(sample_findings), "secret boolean, turn long, window binary"), "findings")

    def take(secret: bool) -> np.ndarray:
        found = rows.filter(F.col("secret") == secret).groupBy("turn").agg(F.min("window").alias("window"))
        raw = [r["window"] for r in found.orderBy("turn").limit(sample_findings).collect()]
        return np.array([np.frombuffer(w, np.uint8) for w in raw], np.uint8).reshape(-1, BEFORE + WITHIN + AFTER)

    return fit(take(True), take(False))


def _cut(raw: bytes, spans: list[tuple[int, int, int]], mark: bytes) -> bytes:
    """A text with each span (in bytes, by start) replaced; overlapping ones are one."""
    out, at = [], 0
    for a, b, _ in spans:
        if a >= at:
            out += [raw[at:a], mark]
        at = max(at, b)
    return b"".join([*out, raw[at:]])


def _scan(shared_network, mark: str | None = None):
    """Adds the spans of each text, or with ``mark`` the text with that in their place."""
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.int32())]))

    def run(batches):
        network = shared_network.value
        for batch in batches:
            text = batch.column(batch.schema.get_field_index("text"))
            rest = batch.drop_columns(["text"])
            for first, last, texts in text_blocks(text):
                found = Findings(texts)
                spans = {i: list(s) for i, s in found.base.items()}
                if network.threshold <= 1:
                    for i, a, b in found.sure(network):
                        spans.setdefault(i, []).append((a, b, 3))
                part = rest.slice(first, last - first)
                if mark is not None:
                    new = text.slice(first, last - first).to_pylist()
                    for i, mine in spans.items():
                        new[i] = _cut(texts[i], sorted(mine, key=lambda s: (s[0], s[2])), mark.encode()).decode("utf-8", "replace")
                    yield pa.RecordBatch.from_arrays([*part.columns, pa.array(new, pa.string())], [*part.schema.names, "_kept_text"])
                    continue
                rows = [None] * len(texts)
                for i, mine in spans.items():
                    chars = np.concatenate(([0], np.cumsum((np.frombuffer(texts[i], np.uint8) & 0xC0) != 0x80)))
                    mine.sort(key=lambda s: (s[0], s[2]))
                    rows[i] = [{"start": int(chars[a]), "end": int(chars[b]), "kind": k} for a, b, k in mine]
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array([r or [] for r in rows], span)], [*part.schema.names, "found"]
                )

    return run


FOUND = "array<struct<start:bigint,end:bigint,kind:int>>"


def scan(docs: DataFrame) -> DataFrame:
    """doc_id and all spans ``found`` (code points; kind is an index into KINDS) of every row of ``docs``.

    Base spans always stay; every run of token characters, or what base spans leave of it, is a
    candidate, and is added where the network is sure enough. A null text is empty; repeated rows get
    equal spans; an empty table gives no rows; a very long text is scored whole, in blocks of
    candidates; columns of ``docs`` named like those returned do not disturb. Only the sample of findings is shuffled.
    """
    network = docs.sparkSession.sparkContext.broadcast(learn(docs))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return map_texts(rows, _scan(network), f"doc_id long, found {FOUND}")


def _listing(spans) -> F.Column:
    named = F.transform(
        spans,
        lambda s: F.concat_ws(":", F.element_at(F.array(*(F.lit(k) for k in KINDS)), s["kind"] + 1), s["start"], s["end"]),
    )
    return F.array_join(named, ",")


def op2(docs: DataFrame) -> DataFrame:
    """The columns of the secret contract."""
    count = lambda kind: F.size(F.filter("found", lambda s: s["kind"] == kind)).cast("long")
    base = F.filter("found", lambda s: s["kind"] < 3)
    return scan(docs).select(
        "doc_id",
        *(count(i).alias(f"n_{k}") for i, k in enumerate(KINDS[:3])),
        F.sha2(_listing(base), 256).alias("base_sha256"),
        _listing(F.col("found")).alias("spans"),
    )


def redact(docs: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """All rows of ``docs``, with every found span replaced by ``mark``; overlapping spans are one.

    ``n_chars``, where present, is set to the length of the new text. A null text stays null, repeated rows are cut
    alike, an empty table gives no rows, and no column of ``docs`` disturbs.
    """
    network = docs.sparkSession.sparkContext.broadcast(learn(docs))
    rows = docs.select(F.struct("*").alias("_row"), "text")
    found = map_texts(rows, _scan(network, mark), f"_row {rows.schema['_row'].dataType.simpleString()}, _kept_text string")
    return with_text(found, docs)
