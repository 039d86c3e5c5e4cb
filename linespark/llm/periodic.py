"""Stretches of words that repeat with a period, from the maximal pairs of each text.

A maximal pair is two places whose words agree for ``l`` words, but neither before nor after. In the
suffix tree of the text its places lie below different children of the node of depth ``l``, and
different words stand to their left. A pair at a distance ``d`` of at most ``l`` covers a stretch of
``l + d`` words with period ``d`` that no neighbouring word extends: a run. Every run is found so
from its first place and the one a period later. In a run of four periods or more also multiples of
the period give pairs; of the pairs of one stretch the smallest distance is the run's period.

1. Texts none of whose ``min_length / 2``-word sequences occurs twice (by hash) have no run.
2. The other texts of a batch get one suffix order by prefix doubling; words of different texts differ.
3. The tree of common-prefix intervals is walked bottom-up. A node has its places in lists, one for each
   left word. Where two children meet, each place of the smaller looks up those of the larger with another left word
   and a distance within the node's depth, then joins their lists. A set of places in which no two are
   near enough for its deepest node is left out beforehand.

A place changes lists a logarithmic number of times; the pairs of a text are as many as its runs' exponents, which grow in
proportion to the text. So time and memory of a text follow its length, also for a word repeated through all of it.

Defined cases: a null or empty text has no words and no runs; a null id is a document like any other; equal rows get
equal results, one each; an empty table gives an empty table. A text is never cut: a task holds one text of any
length with its order (about 200 bytes a word). Further columns are carried in the struct ``key``.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterable, Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Numbers, lean, pieces
from .substrings import mix, rolling
from .suffixes import SuffixOrder

MIN_LENGTH = 12
#: Bytes of text looked at together.
PIECE_BYTES = 4 << 20

Run = tuple[int, int, int]


class Places:
    """The places below a node: by left word, and all in order."""

    __slots__ = ("by_left", "all")

    def __init__(self, place: int, left: int):
        self.by_left = {left: [place]}
        self.all = [place]

    def near(self, place: int, left: int, low: int, high: int) -> Iterator[int]:
        """Places at a distance of low to high with another left word."""
        for begin, end in ((place - high, place - low), (place + low, place + high)):
            i, j = bisect_left(self.all, begin), bisect_right(self.all, end)
            if j - i > len(self.by_left):
                for other, own in self.by_left.items():
                    if other != left:
                        yield from own[bisect_left(own, begin) : bisect_right(own, end)]
            elif j > i:
                same = self.by_left.get(left, ())
                for x in self.all[i:j]:
                    k = bisect_left(same, x)
                    if k == len(same) or same[k] != x:
                        yield x

    def take(self, other: Places) -> None:
        _merge(self.all, other.all)
        for left, own in other.by_left.items():
            if left in self.by_left:
                _merge(self.by_left[left], own)
            else:
                self.by_left[left] = own


def _merge(into: list[int], more: list[int]) -> None:
    if into[-1] < more[0]:
        into.extend(more)
    elif len(more) * 8 > len(into):
        into.extend(more)
        into.sort()
    else:
        for x in more:
            insort(into, x)


def _meet(a: Places, b: Places, depth: int, min_length: int, found: dict[tuple[int, int], int]) -> Places:
    """Report the maximal pairs between two children of a node of this depth, and join them."""
    if len(a.all) < len(b.all):
        a, b = b, a
    low = max(1, min_length - depth)
    for left, places in b.by_left.items():
        for x in places:
            for y in a.near(x, left, low, depth):
                stretch = (min(x, y), depth + abs(x - y))
                found[stretch] = min(abs(x - y), found.get(stretch, abs(x - y)))
    a.take(b)
    return a


def pairs_of(places: list[int], common: list[int], left: list[int], min_length: int, found: dict[tuple[int, int], int]) -> None:
    """Bottom-up walk over the intervals of suffixes in order; ``common[k]`` is what suffix k shares with the one before."""
    stack: list[tuple[int, Places]] = []
    own = Places(places[0], left[0])
    for k in range(1, len(places) + 1):
        depth = common[k] if k < len(places) else 0
        while stack and stack[-1][0] > depth:
            at, node = stack.pop()
            own = _meet(node, own, at, min_length, found)
        if k == len(places):
            break
        if stack and stack[-1][0] == depth:
            stack[-1] = (depth, _meet(stack[-1][1], own, depth, min_length, found))
        else:
            stack.append((depth, own))
        own = Places(places[k], left[k])


def _with_repeats(words: np.ndarray, sizes: np.ndarray, length: int) -> np.ndarray:
    """Numbers of the texts in which some ``length`` words occur twice (more by chance, never fewer)."""
    starts = np.maximum(sizes - length + 1, 0)
    if not starts.sum():
        return np.zeros(0, np.int64)
    doc = np.repeat(np.arange(len(sizes)), starts)
    at = (np.cumsum(sizes) - sizes)[doc] + np.arange(len(doc)) - (np.cumsum(starts) - starts)[doc]
    grams = mix(rolling(mix(words.astype(np.uint64) + np.uint64(1)), length)[at] + mix(doc.astype(np.uint64)))
    sorted_ = np.sort(grams)
    twice = sorted_[1:][sorted_[1:] == sorted_[:-1]]
    return np.unique(doc[np.isin(grams, twice)]) if len(twice) else np.zeros(0, np.int64)


def runs_of(texts: list[np.ndarray], min_length: int = MIN_LENGTH) -> list[list[Run]]:
    """The runs (start, length, period) of each sequence of word numbers, by start, then period."""
    half = -(-min_length // 2)
    sizes = np.array([len(t) for t in texts], np.int64)
    words = np.concatenate([np.zeros(0, np.int64), *texts])
    result: list[list[Run]] = [[] for _ in texts]
    some = _with_repeats(words, sizes, half)
    if not len(some):
        return result
    begins = np.cumsum(sizes) - sizes
    doc = np.repeat(np.arange(len(some)), sizes[some])
    own = np.concatenate([words[begins[i] : begins[i] + sizes[i]] for i in some])
    symbols = np.unique(doc * (int(own.max()) + 1) + own, return_inverse=True)[1]
    suffixes = SuffixOrder(symbols, keep_levels=True)
    order = suffixes.order
    common = np.r_[0, suffixes.common(order[:-1], order[1:])]
    # Sets of suffixes that share ``half`` words, the least depth of a node with pairs of runs.
    deep = common >= half
    inside = deep | np.r_[deep[1:], False]
    order, common, deep = order[inside], common[inside], deep[inside]
    group = np.cumsum(~deep) - 1
    by_place = np.lexsort((order, group))
    gaps = np.r_[np.iinfo(np.int64).max, np.diff(order[by_place])]
    firsts = np.flatnonzero(~deep)
    gaps[firsts] = np.iinfo(np.int64).max
    if not len(firsts):
        return result
    wanted = np.minimum.reduceat(gaps, firsts) <= np.maximum.reduceat(np.where(deep, common, 0), firsts)
    base = np.cumsum(sizes[some]) - sizes[some]
    ends = np.r_[firsts[1:], len(order)]
    alone = count(-1, -1)
    found: list[dict[tuple[int, int], int]] = [{} for _ in some]
    for i in np.flatnonzero(wanted):
        rows = slice(firsts[i], ends[i])
        which = int(doc[order[firsts[i]]])
        places = (order[rows] - base[which]).tolist()
        left = [int(own[base[which] + p - 1]) if p else next(alone) for p in places]
        pairs_of(places, common[rows].tolist(), left, min_length, found[which])
    for i, pairs in zip(some, found, strict=True):
        result[i] = sorted(((start, length, period) for (start, length), period in pairs.items()), key=lambda r: (r[0], r[2]))
    return result


def collapsed(words: list, runs: list[Run]) -> list:
    """The words without those that a run repeats after its first period."""
    if not runs:
        return words
    change = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        change[start + period] += 1
        change[start + length] -= 1
    return [w for w, n in zip(words, np.cumsum(change[:-1]).tolist(), strict=True) if not n]


RUN_KIND = "struct<start:bigint,length:bigint,period:bigint>"
_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


@lean
def _find(batches: Iterable[pa.RecordBatch], min_length: int) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches, 1, PIECE_BYTES):
        numbers = Numbers()
        words = [(t or "").encode("utf-8").split() for t in batch.column(1).to_pylist()]
        runs = runs_of([np.fromiter(map(numbers.__getitem__, own), np.int64, len(own)) for own in words], min_length)
        ends = np.cumsum([0, *map(len, runs)]).astype(np.int32)
        flat = np.array([r for own in runs for r in own], np.int64).reshape(-1, 3)
        listed = pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays([pa.array(flat[:, i]) for i in range(3)], fields=list(_RUN)))
        kept = pa.array([b" ".join(collapsed(w, r)).decode("utf-8") for w, r in zip(words, runs, strict=True)], pa.string())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(w) for w in words], pa.int64()), listed, kept], ["key", "n_words", "runs", "text"])


def find_runs(docs: DataFrame, text_col: str = "text", min_length: int = MIN_LENGTH) -> DataFrame:
    """(key, n_words, runs, text) of every row; ``text`` has the words outside repeats, joined by one space.

    ``runs`` are structs (start, length, period) by start, then period. ``key`` holds all other columns.
    """
    if min_length < 2:
        raise ValueError("min_length must be 2 or more")
    key = F.struct(*(F.col(f"`{c}`") for c in docs.columns if c != text_col))
    rows = docs.select(key.alias("key"), F.col(f"`{text_col}`").cast("string").alias("text"))
    kind = rows.schema["key"].dataType.simpleString()
    return rows.mapInArrow(lambda batches: _find(batches, min_length), f"key {kind}, n_words long, runs array<{RUN_KIND}>, text string")
