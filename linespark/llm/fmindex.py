"""An index of a word sequence that is searched backwards: wavelet matrix of the transform, sampled places."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from .suffixes import SuffixOrder

#: Every so many places of the sequence are kept.
SAMPLED = 16


class Bits:
    """A bit vector that counts the ones before a place."""

    def __init__(self, packed: np.ndarray):
        self.words = packed
        self.before = np.zeros(len(packed) + 1, np.int32)
        np.cumsum(np.bitwise_count(packed), out=self.before[1:], dtype=np.int32)

    @staticmethod
    def pack(flags: np.ndarray) -> np.ndarray:
        """64 flags a word; one word more than needed, so that every place has one."""
        whole = np.zeros((len(flags) // 64 + 1) * 64, bool)
        whole[: len(flags)] = flags
        return np.packbits(whole, bitorder="little").view(np.uint64)

    def ones(self, at: np.ndarray) -> np.ndarray:
        word, bit = at >> 6, (at & 63).astype(np.uint64)
        return self.before[word] + np.bitwise_count(self.words[word] & ((np.uint64(1) << bit) - np.uint64(1)))

    def get(self, at: np.ndarray) -> np.ndarray:
        return (self.words[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1) == 1


def _width(n_symbols: int) -> int:
    return max(1, (n_symbols - 1).bit_length())


def wavelet_bits(symbols: np.ndarray, n_symbols: int) -> np.ndarray:
    """One row of packed bits for each binary digit, highest first; each row's zeros stand first in the next one's order."""
    rows = []
    for level in range(_width(n_symbols) - 1, -1, -1):
        one = (symbols >> level) & 1 == 1
        rows.append(Bits.pack(one))
        symbols = np.concatenate([symbols[~one], symbols[one]])
    return np.stack(rows)


@dataclass
class Stored:
    """What an index keeps: sequence length, first row of each symbol, wavelet rows, which rows are sampled, their places."""

    size: int
    firsts: np.ndarray
    wavelet: np.ndarray
    marked: np.ndarray
    samples: np.ndarray


def build(symbols: np.ndarray, n_symbols: int) -> Stored:
    """Index of a sequence whose last symbol is 0 and occurs nowhere else."""
    order = SuffixOrder(symbols).order
    marked = order % SAMPLED == 0
    firsts = np.r_[0, np.cumsum(np.bincount(symbols, minlength=n_symbols))]
    return Stored(len(symbols), firsts.astype(np.int32), wavelet_bits(symbols[order - 1], n_symbols), Bits.pack(marked), order[marked].astype(np.int32))


class Index:
    """Counts and locates phrases; all steps take many rows at once."""

    def __init__(self, stored: Stored):
        self.firsts = stored.firsts.astype(np.int64)
        n = len(self.firsts) - 1
        self.width = _width(n)
        self.rows = [Bits(row) for row in stored.wavelet]
        self.zeros = [stored.size - int(row.ones(np.array([stored.size]))[0]) for row in self.rows]
        self.marked, self.samples = Bits(stored.marked), stored.samples.astype(np.int64)
        # Below the lowest level symbols stand by their digits read backwards.
        symbol = np.arange(n)
        backwards = np.zeros(n, np.int64)
        for level in range(self.width):
            backwards |= ((symbol >> level) & 1) << (self.width - 1 - level)
        by = np.argsort(backwards)
        self.below = np.zeros(n, np.int64)
        self.below[by] = np.r_[0, np.cumsum(np.diff(self.firsts)[by])[:-1]]

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often the symbol stands before a row of the transform."""
        for i, row in enumerate(self.rows):
            ones = row.ones(at)
            one = (symbol >> (self.width - 1 - i)) & 1 == 1
            at = np.where(one, self.zeros[i] + ones, at - ones)
        return at - self.below[symbol]

    def back(self, at: np.ndarray) -> np.ndarray:
        """The row of the suffix that starts one place earlier."""
        symbol = np.zeros(len(at), np.int64)
        for i, row in enumerate(self.rows):
            one, ones = row.get(at), row.ones(at)
            symbol = (symbol << 1) | one
            at = np.where(one, self.zeros[i] + ones, at - ones)
        return self.firsts[symbol] + at - self.below[symbol]

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and end row of each phrase; phrases are aligned to the right and filled up with -1."""
        last = phrases[:, -1]
        low, high = self.firsts[last], self.firsts[last + 1]
        for column in range(phrases.shape[1] - 2, -1, -1):
            live = np.flatnonzero((low < high) & (phrases[:, column] >= 0))
            if not len(live):
                break
            symbol = phrases[live, column]
            both = self.rank(np.r_[symbol, symbol], np.r_[low[live], high[live]])
            low[live] = self.firsts[symbol] + both[: len(live)]
            high[live] = self.firsts[symbol] + both[len(live) :]
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """The places of the rows' suffixes: back to the nearest sampled place."""
        place = np.zeros(len(rows), np.int64)
        open_, steps = np.arange(len(rows)), 0
        while len(open_):
            done = self.marked.get(rows)
            place[open_[done]] = self.samples[self.marked.ones(rows[done])] + steps
            open_, rows, steps = open_[~done], self.back(rows[~done]), steps + 1
        return place
