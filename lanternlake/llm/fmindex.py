"""FM-index of a shard of word numbers: suffix order, wavelet matrix, backward search and location."""

from __future__ import annotations

import numpy as np

#: Every so many text positions keep their suffix number.
SAMPLE = 16


def suffix_order(text: np.ndarray) -> np.ndarray:
    """Suffix array of ``text``, whose zeros are separators that differ from each other by position.

    The text ends with a zero. Suffixes are sorted by as many leading symbols as fit a 64-bit key beside
    the position, and ties that no separator has ended are refined by doubling.
    """
    n = len(text)
    bits, place = int(text.max(initial=1)).bit_length(), max(1, (n - 1).bit_length())
    depth = max(1, (64 - place) // bits)
    key = np.zeros(n, np.uint64)
    ended = np.zeros(n, bool)
    for k in range(depth):
        symbol = np.concatenate((text[k:], np.zeros(min(k, n), text.dtype)))
        symbol = np.where(ended, 0, symbol)
        key = key << np.uint64(bits) | symbol.astype(np.uint64)
        ended |= symbol == 0
    key = np.sort(key << np.uint64(place) | np.arange(n, dtype=np.uint64))
    order = (key & np.uint64((1 << place) - 1)).astype(np.int64)
    key >>= np.uint64(place)
    new = np.concatenate(([True], key[1:] != key[:-1])) | ended[order]
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    while True:
        # Rows whose group has more than one member, each group in its place.
        open_ = ~new | np.concatenate((~new[1:], [False]))
        rows = np.flatnonzero(open_)
        if not len(rows):
            return order
        at = order[rows]
        head, tail = rank[at], rank[at + depth]
        if 3 * place <= 64:
            key = (head.astype(np.uint64) << np.uint64(2 * place)) | (tail.astype(np.uint64) << np.uint64(place)) | at.astype(np.uint64)
            key.sort()
            at = (key & np.uint64((1 << place) - 1)).astype(np.int64)
            key >>= np.uint64(place)
            differs = np.concatenate(([True], key[1:] != key[:-1]))
        else:
            by = np.lexsort((at, tail, head))
            at, head, tail = at[by], head[by], tail[by]
            differs = np.concatenate(([True], (head[1:] != head[:-1]) | (tail[1:] != tail[:-1])))
        order[rows] = at
        new[rows] = differs
        rank[at] = np.maximum.accumulate(np.where(differs, rows, 0))
        depth *= 2


class FMIndex:
    """Backward search over ``text``: numbers from 1, with zeros as separators and at the end."""

    def __init__(self, text: np.ndarray):
        self.n = len(text)
        suffixes = suffix_order(text)
        before = text[suffixes - 1]
        self.levels = max(1, int(text.max(initial=1)).bit_length())
        self.counts = np.concatenate(([0], np.cumsum(np.bincount(text, minlength=1 << self.levels))))
        self.ones, self.zeros = [], []
        symbols = before
        for level in range(self.levels - 1, -1, -1):
            bit = (symbols >> level & 1).astype(bool)
            ones = np.zeros(self.n + 1, np.int32)
            np.cumsum(bit, out=ones[1:])
            self.ones.append(ones)
            self.zeros.append(self.n - int(ones[-1]))
            symbols = np.concatenate((symbols[~bit], symbols[bit]))
        # Walks to the left end at a sampled position or behind a separator at the latest.
        keep = (suffixes % SAMPLE == 0) | (before == 0)
        self.kept = np.zeros(self.n + 1, np.int32)
        np.cumsum(keep, out=self.kept[1:])
        self.samples = suffixes[keep]

    def rank(self, symbol: np.ndarray, row: np.ndarray) -> np.ndarray:
        """Occurrences of each symbol before each row, from its place at the lowest level."""
        start = np.zeros(len(row), np.int64)
        for k, level in enumerate(range(self.levels - 1, -1, -1)):
            ones, zeros = self.ones[k], self.zeros[k]
            bit = (symbol >> level & 1).astype(bool)
            row = np.where(bit, zeros + ones[row], row - ones[row])
            start = np.where(bit, zeros + ones[start], start - ones[start])
        return row - start

    def search(self, flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Suffix rows [low, high) of each pattern ``flat[start : start + length]``."""
        low, high = np.zeros(len(starts), np.int64), np.where(lengths > 0, self.n, 0).astype(np.int64)
        alive = np.flatnonzero(lengths > 0)
        for back in range(1, int(lengths.max(initial=0)) + 1):
            alive = alive[lengths[alive] >= back]
            if not len(alive):
                break
            symbol = flat[starts[alive] + lengths[alive] - back].astype(np.int64)
            # A symbol that the text lacks may lie above the levels of the tree.
            known = symbol < 1 << self.levels
            high[alive[~known]] = low[alive[~known]]
            alive, symbol = alive[known], symbol[known]
            both = self.rank(np.tile(symbol, 2), np.concatenate((low[alive], high[alive])))
            base = self.counts[symbol]
            low[alive], high[alive] = base + both[: len(alive)], base + both[len(alive) :]
            alive = alive[low[alive] < high[alive]]
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text position of each suffix row, by walks to the left until a sample."""
        out = np.zeros(len(rows), np.int64)
        todo, row, steps = np.arange(len(rows)), rows.astype(np.int64), 0
        while len(todo):
            known = self.kept[row + 1] > self.kept[row]
            out[todo[known]] = self.samples[self.kept[row[known]]] + steps
            todo, row = todo[~known], row[~known]
            symbol, at = np.zeros(len(row), np.int64), row
            for k in range(self.levels):
                ones, zeros = self.ones[k], self.zeros[k]
                bit = ones[at + 1] > ones[at]
                at = np.where(bit, zeros + ones[at], at - ones[at])
                symbol = symbol << 1 | bit
            row = self.counts[symbol] + self.rank(symbol, row)
            steps += 1
        return out
