"""Token counts by a finite-state transducer compiled from a piece vocabulary.

Merging pieces by score is a local process: the last piece of the encoding of a prefix, together with
the pieces that end where a later piece may begin, decides how the encoding goes on. Those facts are
the state of a deterministic transducer over code points. A transition carries the change of the
number of emitted pieces (negative where a longer piece replaces shorter ones), so that the count of a
text is the sum over its path. States are compiled as they are first reached.

Pieces never run across the start of a word, so the transducer is reset there. A chunk of text is a map
from entry states to exit states and counts. With a word start in it the map is constant from there on.
The other maps are tabulated for the states that occur, all chunks at a time, and composed by a parallel
prefix scan, which doubles the chunks that a composed map spans in each step.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import map_texts, text_blocks

MODEL = "piece_bpe_32k.model"
TOKEN_LIMIT = 4096
#: Code points of a chunk.
CHUNK = 192
#: Compiled transitions and states of a Python worker, which then begins anew, within a text if need be. A transition
#: takes up to 48 bytes in the table, a state is a Python object of about 1 KB.
MAX_TRANSITIONS, MAX_STATES = 1_000_000, 250_000
#: Bytes of texts that are handled together.
BLOCK_BYTES = 1 << 20
#: Pairs of pieces that are remembered.
MAX_PAIRS = 300_000
#: Code points of a text that are handled together, and the fewest to which a stretch is cut when the tables are full.
STRETCH, LEAST_STRETCH = 1 << 17, 1 << 10
SPACE = "▁"
_DELTA = 32
#: Exit states of a stretch without word starts for all of which its chunks are tabulated, where their own do not meet.
COMMON_STATES = 16


class Vocabulary:
    """Pieces and scores of a sentencepiece BPE model with byte fallback and no other normalisation."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = range(model.get_piece_size())
        special = [i for i in ids if model.is_control(i) or model.is_byte(i) or model.is_unknown(i)]
        self.score = {model.id_to_piece(i): model.get_score(i) for i in set(ids) - set(special)}
        if any(SPACE in p.lstrip(SPACE) for p in self.score):
            raise ValueError("a piece runs across the start of a word")
        probe = model.encode("a  b ", out_type=str)
        if "".join(probe) != SPACE + "a" + 2 * SPACE + "b" + SPACE or not model.is_byte(model.piece_to_id("<0x00>")):
            raise ValueError("the model normalises texts in a way that is not supported")
        self.prefixes = {p[:n] for p in self.score for n in range(1, len(p))}
        self.pairs: dict[tuple[str, str], bool] = {}
        self.whole: dict[str, bool] = {}

    def encode(self, text: str) -> list[str]:
        """Pieces of a short text: the best-scored neighbours merge first, the leftmost of equals."""
        parts, score = list(text), self.score
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                s = score.get(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def is_piece(self, text: str) -> bool:
        """Whether the encoding of ``text`` is the one piece ``text``."""
        if text not in self.score:
            return False
        if text not in self.whole:
            self.whole[text] = len(text) == 1 or self.encode(text) == [text]
        return self.whole[text]

    def may_follow(self, left: str | None, right: str) -> bool:
        """Whether ``left`` and ``right`` stay apart next to each other; None is a boundary."""
        if left is None:
            return True
        key = (left, right)
        if key not in self.pairs:
            if len(self.pairs) >= MAX_PAIRS:
                self.pairs.clear()
            self.pairs[key] = self.encode(left + right) == [left, right]
        return self.pairs[key]


class Full(Exception):
    """The tables of a transducer have reached their bound."""


class Transitions:
    """A hash table from (state, column) to packed transitions, of vectors at a time."""

    def __init__(self):
        self.size, self.bits = 0, 16
        self.keys, self.values = np.full(1 << self.bits, -1, np.int64), np.zeros(1 << self.bits, np.int32)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """The slot of each key, or the empty one where it would go."""
        mask = len(self.keys) - 1
        slot = (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self.bits)).astype(np.int64)
        held = self.keys[slot]
        open_ = np.flatnonzero((held != keys) & (held >= 0))
        while len(open_):
            slot[open_] = (slot[open_] + 1) & mask
            held = self.keys[slot[open_]]
            open_ = open_[(held != keys[open_]) & (held >= 0)]
        return slot

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Packed transitions, -1 where there is none."""
        slot = self.slots(keys)
        return np.where(self.keys[slot] == keys, self.values[slot], -1)

    def put(self, keys: np.ndarray, values: np.ndarray) -> None:
        """Add new keys, which differ from each other."""
        self.size += len(keys)
        if self.size > MAX_TRANSITIONS:
            raise Full
        if 2 * self.size >= len(self.keys):
            held = self.keys >= 0
            keys, values = np.concatenate((self.keys[held], keys)), np.concatenate((self.values[held], values))
            self.bits = int(2 * self.size).bit_length() + 1
            self.keys, self.values = np.full(1 << self.bits, -1, np.int64), np.zeros(1 << self.bits, np.int32)
        while len(keys):  # of several keys for a slot one stays, the others go on
            slot = self.slots(keys)
            self.keys[slot], self.values[slot] = keys, values
            left = self.keys[slot] != keys
            keys, values = keys[left], values[left]


class Transducer:
    """Lazily compiled deterministic transducer of a vocabulary; see the module."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        #: Column of each code point; 1 to 4 are the code points without a piece, by their UTF-8 bytes.
        self.column_of = np.full(0x110000, 4, np.int32)
        self.column_of[:0x10000], self.column_of[:0x800], self.column_of[:0x80] = 3, 2, 1
        self.symbols: list[str | int] = [0, 1, 2, 3, 4]
        self.own = {ord(p): p for p in vocabulary.score if len(p) == 1}
        self.known = np.zeros(0x110000, bool)
        self.known[list(self.own)] = True
        self.table = Transitions()
        # A state is a tuple of (suffix that begins some piece, last piece before it, count before it
        # less the count here), shortest suffix first. The empty suffix always stands there.
        self.states: list[tuple] = [(("", None, 0),)]
        self.number = {self.states[0]: 0}
        self.space = self.column(np.array([ord(SPACE)]))[0]

    def column(self, points: np.ndarray) -> np.ndarray:
        """Table columns of code points; a code point that is a piece gets one when first seen."""
        fresh = self.known[points]
        if fresh.any():
            for point in np.unique(points[fresh]).tolist():
                self.known[point] = False
                self.column_of[point] = len(self.symbols)
                self.symbols.append(self.own[point])
        return self.column_of[points]

    def compile(self, state: int, column: int) -> int:
        """Target state and change of the count on one transition, packed."""
        symbol, vocabulary = self.symbols[column], self.vocabulary
        facts = self.states[state]
        if column == self.space and facts[0][1] is not None and not facts[0][1].endswith(SPACE):
            packed = self.step(0, column)
        elif isinstance(symbol, int):
            packed = self.pack((("", None, 0),), symbol)
        else:
            for suffix, last, before in facts:
                piece = suffix + symbol
                if vocabulary.is_piece(piece) and vocabulary.may_follow(last, piece):
                    delta = before + 1
                    break
            else:
                raise AssertionError("no piece ends here")
            new = [("", piece, 0)]
            new += [(s + symbol, last, b - delta) for s, last, b in facts if s + symbol in vocabulary.prefixes]
            packed = self.pack(tuple(new), delta)
        return packed

    def pack(self, facts: tuple, delta: int) -> int:
        if not -_DELTA <= delta < _DELTA:
            raise ValueError("a piece of this model replaces more pieces than a transition can hold")
        return self.intern(facts) * 2 * _DELTA + delta + _DELTA

    def intern(self, facts: tuple) -> int:
        if facts not in self.number:
            if len(self.states) >= MAX_STATES:
                raise Full
            self.number[facts] = len(self.states)
            self.states.append(facts)
        return self.number[facts]

    def step(self, state: int, column: int) -> int:
        table, key = self.table, state << 32 | column
        slot = (key * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF) >> 64 - table.bits
        while (held := table.keys[slot]) != key:
            if held < 0:
                packed = self.compile(state, column)
                self.table.put(np.array([key]), np.array([packed], np.int32))
                return packed
            slot = (slot + 1) & (len(table.keys) - 1)
        return int(table.values[slot])

    def run(self, columns: np.ndarray, starts: np.ndarray, ends: np.ndarray, entry: np.ndarray):
        """Exit states and counts of the stretches ``columns[start:end]`` from their entry states."""
        state, count = entry.astype(np.int64), np.zeros(len(starts), np.int64)
        length = ends - starts
        order = np.argsort(-length, kind="stable")
        alive = np.searchsorted(-length[order], -np.arange(1, (length.max() if len(length) else 0) + 1), "right")
        s, total, at = state[order], count[order], starts[order]
        for k, n in enumerate(alive.tolist()):
            if n < 24:
                break
            key = s[:n] << 32 | columns[at[:n] + k]
            packed = self.table.find(key)
            missing = np.flatnonzero(packed < 0)
            if len(missing):
                pairs, where = np.unique(key[missing], return_inverse=True)
                fresh = np.array([self.compile(p >> 32, p & 0xFFFFFFFF) for p in pairs.tolist()], np.int32)
                packed[missing] = fresh[where]
                # What compiled one on its way to another has put it already.
                there = self.table.find(pairs) >= 0
                self.table.put(pairs[~there], fresh[~there])
            s[:n] = packed >> 6
            total[:n] += (packed & 63) - _DELTA
        else:
            k = len(alive)
        for i in range(alive[k] if k < len(alive) else 0):  # the few longest, one by one
            now, sum_ = int(s[i]), 0
            for column in columns[at[i] + k : at[i] + length[order[i]]].tolist():
                packed = self.step(now, column)
                now, sum_ = packed >> 6, sum_ + (packed & 63) - _DELTA
            s[i], total[i] = now, total[i] + sum_
        state[order], count[order] = s, total
        return state, count

    def compose(self, columns, starts, ends, constant, exits, counts) -> None:
        """Fill in ``exits`` and ``counts`` of the chunks whose maps are not constant.

        A table has a row for each chunk and entry state that occurs, first the state in which the chunk
        before ends when it is entered anew. Rows name the row of the next chunk that they lead to, and
        missing rows are added until every row on the path from a known state is there. Which rows those
        are is found by doubling: after k steps all within 2**k chunks of a known state are marked.
        """
        chunks = np.flatnonzero(~constant)
        if not len(chunks):
            return
        evaluate = lambda keys: self.run(columns, starts[keys >> 32], ends[keys >> 32], keys & 0xFFFFFFFF)
        guess = exits.copy()
        guess[chunks] = self.run(columns, starts[chunks], ends[chunks], np.zeros(len(chunks), np.int64))[0]
        keys = (chunks << 32) + guess[chunks - 1]
        known = keys[constant[chunks - 1]]
        goes_on = np.append(~constant, False)
        chain = np.cumsum(constant)
        to, change = evaluate(keys)
        turn = 0
        while True:
            leads = np.where(goes_on[(keys >> 32) + 1], (((keys >> 32) + 1) << 32) + to, -1)
            at = np.minimum(np.searchsorted(keys, leads), len(keys) - 1)
            there = (leads >= 0) & (keys[at] == leads)
            # A last row that leads to itself stands for the end of a path.
            jump = np.append(np.where(there, at, len(keys)), len(keys))
            marked = np.zeros(len(keys) + 1, bool)
            marked[np.searchsorted(keys, known)] = True
            for _ in range(int(np.ceil(np.log2(len(chunks) + 1)))):
                marked[jump[marked]] = True
                jump = jump[jump]
            missing = (leads >= 0) & ~there
            if not (missing & marked[:-1]).any():
                break
            more = np.unique(leads[missing])
            turn += 1
            if turn > 1:
                for number in np.unique(chain[more >> 32]).tolist():
                    mine = chunks[chain[chunks] == number]
                    states = np.unique(to[chain[keys >> 32] == number])
                    if len(states) <= COMMON_STATES:
                        more = np.union1d(more, np.setdiff1d((mine[:, None] << 32) + states, keys))
            found = evaluate(more)
            keys = np.concatenate((keys, more))
            order = np.argsort(keys)
            keys, to, change = keys[order], np.concatenate((to, found[0]))[order], np.concatenate((change, found[1]))[order]
        path = np.flatnonzero(marked[:-1])
        exits[keys[path] >> 32], counts[keys[path] >> 32] = to[path], change[path]

    def counts(self, texts: list[str]) -> np.ndarray:
        """Number of pieces of each text."""
        return self.stretches([SPACE + t if t else t for t in texts])[0]

    def stretches(self, texts: list[str], entry: tuple | None = None) -> tuple[np.ndarray, tuple]:
        """Pieces of each of ``texts``, and the facts of the state after the last one.

        A text begins with SPACE, unless it is a single one that goes on from the facts ``entry``.
        """
        joined = "".join(texts).replace(" ", SPACE)
        columns = self.column(np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)).astype(np.int64)
        sizes = np.array([len(t) for t in texts], np.int64)
        if not len(columns):
            return np.zeros(len(texts), np.int64), entry or self.states[0]
        # Chunks: none crosses the end of a text.
        pieces = -(-sizes // CHUNK)
        owner = np.repeat(np.arange(len(texts)), pieces)
        nth = np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        begin = np.cumsum(sizes) - sizes
        starts = begin[owner] + nth * CHUNK
        ends = np.minimum(starts + CHUNK, (begin + sizes)[owner])
        # First word start of each chunk, or its end.
        is_space = columns == self.space
        resets = np.flatnonzero(is_space & np.concatenate(([entry is None], ~is_space[:-1])))
        if entry is None:
            resets = np.union1d(resets, begin[sizes > 0])
        at = np.searchsorted(resets, starts)
        first = np.minimum(np.append(resets, len(columns))[at], ends)
        exits, counts = self.run(columns, first, ends, np.zeros(len(starts), np.int64))
        constant = first < ends
        if entry is not None:
            exits[:1], counts[:1] = self.run(columns, starts[:1], ends[:1], np.array([self.intern(entry)]))
            constant[0], first[0] = True, starts[0]
        self.compose(columns, starts, ends, constant, exits, counts)
        heads = np.flatnonzero(constant & (first > starts))
        counts[heads] += self.run(columns, starts[heads], first[heads], exits[heads - 1])[1]
        return np.bincount(owner, counts, len(texts)).astype(np.int64), self.states[exits[-1]]


class Counter:
    """Counts texts with a transducer that begins anew whenever its tables are full."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        self.machine = Transducer(vocabulary)

    def stretches(self, texts: list[str], entry: tuple | None = None) -> tuple[np.ndarray, tuple]:
        """Like those of the transducer. What fills its tables is cut in two; a stretch of a text hands its facts on."""
        for _ in range(2):
            try:
                return self.machine.stretches(texts, entry)
            except Full:
                self.machine = None
                self.machine = Transducer(self.vocabulary)
        if len(texts) > 1:
            half = len(texts) // 2
            first, second = self.stretches(texts[:half]), self.stretches(texts[half:])
            return np.concatenate((first[0], second[0])), second[1]
        text = texts[0]
        if len(text) < LEAST_STRETCH:
            raise ValueError("a short stretch fills the tables")
        first = self.stretches([text[: len(text) // 2]], entry)
        second = self.stretches([text[len(text) // 2 :]], first[1])
        return first[0] + second[0], second[1]

    def counts(self, texts: Iterable[str]) -> np.ndarray:
        """Number of pieces of each text; a long one is taken in stretches."""
        texts = [SPACE + t if t else t for t in texts]
        if len(texts) > 1 or not texts or len(texts[0]) <= STRETCH:
            return self.stretches(texts)[0]
        total, facts = 0, None
        for low in range(0, len(texts[0]), STRETCH):
            found, facts = self.stretches([texts[0][low : low + STRETCH]], facts)
            total += found
        return total


_counters: dict[str, Counter] = {}


def counter(path: str) -> Counter:
    """The counter of a worker process."""
    if path not in _counters:
        _counters[path] = Counter(Vocabulary(path))
    return _counters[path]


def _count(model: str):
    def run(batches):
        import public_tokenizers

        path = public_tokenizers.path(model)
        for batch in batches:
            text = batch.column(batch.schema.get_field_index("text"))
            rest = batch.drop_columns(["text"])
            for first, last, texts in text_blocks(text, BLOCK_BYTES):
                found = counter(path).counts(t.decode("utf-8", "replace") for t in texts)
                part = rest.slice(first, last - first)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(found)], [*part.schema.names, "n_tokens"])

    return run


def token_counts(docs: DataFrame, model: str = MODEL, limit: int = TOKEN_LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit of every row of ``docs``; a null text is empty and has none.

    ``model`` names a file of the public tokenizers. Other columns are not read; rows repeat as they do
    in the input; an empty table gives no rows; a very long text stands in a block of its own and is cut
    into chunks like any other, with or without spaces; nothing is shuffled.
    """
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"),
        "text",
    )
    counted = map_texts(rows, _count(model), "doc_id long, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)


op4 = token_counts
