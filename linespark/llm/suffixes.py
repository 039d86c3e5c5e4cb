"""Suffix order of word sequences by prefix doubling, with numpy."""

from __future__ import annotations

import numpy as np


def places_by(values: np.ndarray, bits: int) -> np.ndarray:
    """Places in the order of their values (ties: by place); the values have ``bits`` bits at most."""
    place_bits = max(1, int(len(values)).bit_length())
    if bits + place_bits > 63:
        return np.argsort(values, kind="stable")
    packed = (values.astype(np.int64) << place_bits) | np.arange(len(values))
    packed.sort()
    return packed & ((1 << place_bits) - 1)


def _heads(new: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Of rows cut where ``new``, the value of ``first`` at the cut before each."""
    return first[np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))]


class SuffixOrder:
    """The order of all suffixes of ``symbols`` (whole numbers from 0), the end counting as smallest.

    ``order`` holds the suffixes' starts. With ``keep_levels``, ``levels`` holds ranks by the first 1, 2, 4, ...
    symbols, from which common prefixes follow.
    """

    def __init__(self, symbols: np.ndarray, keep_levels: bool = False):
        n = len(symbols)
        self.n = n
        width, h = max(1, int(symbols.max(initial=0)).bit_length()), 1
        first = symbols.astype(np.int64)
        if not keep_levels and 2 * width + n.bit_length() < 62:
            # Two symbols at once; the end counts as smallest.
            first, width, h = (first << (width + 1)) | (np.r_[first[1:], -1] + 1), 2 * width + 1, 2
        order = places_by(first, width)
        sorted_ = first[order]
        new = np.r_[True, sorted_[1:] != sorted_[:-1]] if n else np.zeros(0, bool)
        # A rank is one more than the place of its group's first suffix; 0 stands for the end.
        rank = np.zeros(n + 1, np.int64)
        rank[order] = _heads(new, np.arange(n)) + 1
        self.levels = [rank.astype(np.int32)]
        ends = np.r_[new[1:], True]
        at = np.flatnonzero(~(new & ends))
        bits = max(1, n.bit_length())
        while len(at):
            tied = order[at]
            second = rank[np.minimum(tied + h, n)]
            first = rank[tied]
            # Ties stand in the order of their groups already; the pair sorts them within.
            dense = np.cumsum(np.r_[0, first[1:] != first[:-1]])
            step = places_by((dense << bits) | second, bits + max(1, int(dense[-1]).bit_length()))
            tied, first, second = tied[step], first[step], second[step]
            order[at] = tied
            new = np.r_[True, (first[1:] != first[:-1]) | (second[1:] != second[:-1])]
            rank[tied] = _heads(new, at) + 1
            if keep_levels:
                self.levels.append(rank.astype(np.int32))
            at = at[~(new & np.r_[new[1:], True])]
            h *= 2
        self.order = order

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Length of the common prefix of suffixes at different places (levels must be kept)."""
        total = np.zeros(len(a), np.int64)
        for k in range(len(self.levels) - 1, -1, -1):
            level = self.levels[k]
            same = level[np.minimum(a + total, self.n)] == level[np.minimum(b + total, self.n)]
            total += same.astype(np.int64) << k
        return total
