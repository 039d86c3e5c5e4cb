"""Spelling variants: words of a vocabulary that differ by one inserted, deleted or replaced letter.

1. A word's vector counts its letters by ``LEVELS`` groups. One edit adds one letter at most (a surplus) and
   takes one away at most (a deficit), so words that are near have vectors within a budget of one each.
2. The words stand in a trie by their counts, one group a level. Its upper nodes with more than ``cell_words`` words
   are counted first (at most ``MAX_NODES`` a level, as a node has at least a ``MAX_NODES``-th of the words) and sent to the
   tasks. Below them lie the cells. A word is a leaf of its own cell and a query of each cell that a depth-first
   search reaches within the budget; cells are dealt out by a shuffle, so no task sees the whole vocabulary.
3. In a cell the search goes on down the trie, with all queries that reach a node at once; each spends its budget where
   its count differs. The words of the leaves are verified letter by letter, and only a query's number of
   near words and its best one leave the task.
4. A word's form is its near word of the largest count, if that is at least twice its own. Roots follow the forms by
   doubling, in as many steps as the logarithm of the longest way.

Words with the same vector can't be told apart by a trie: they are one leaf, in one task.

Defined cases: null words are left out; an empty vocabulary gives an empty table; a word's row stands once, its occurrences
added up; words of any length are taken whole.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import lean, written

#: Letters with a level of their own, the most frequent ones first; all others share the levels after these.
SINGLE_LETTERS = "enitaorshu"
SHARED_LEVELS = 6
LEVELS = len(SINGLE_LETTERS) + SHARED_LEVELS
#: Words of a cell, and upper nodes of a level, at most.
CELL_WORDS, MAX_NODES = 16_384, 4096
#: Letters compared at once.
COMPARED = 1 << 22
#: An odd constant, the base of the halves' hashes.
BASE = 0x9E3779B97F4A7C15
MIN_LETTERS, MIN_COUNT, LEAD = 5, 3, 2

Node = tuple[int, ...]


def letters(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The code points of all words in a row, and the words' lengths."""
    return np.frombuffer("".join(words).encode("utf-32-le"), np.uint32), np.array([len(w) for w in words], np.int64)


def vectors(words: list[str]) -> np.ndarray:
    """Letter counts by group, one row a word."""
    codes, sizes = letters(words)
    low = np.arange(256)
    known = len(SINGLE_LETTERS) + low % SHARED_LEVELS
    known[[ord(letter) for letter in SINGLE_LETTERS]] = np.arange(len(SINGLE_LETTERS))
    group = known[codes] if codes.max(initial=0) < 256 else np.where(codes < 256, known[np.minimum(codes, 255)], len(SINGLE_LETTERS) + codes % SHARED_LEVELS)
    word = np.repeat(np.arange(len(words)), sizes)
    return np.bincount(word * LEVELS + group, minlength=len(words) * LEVELS).reshape(-1, LEVELS).astype(np.int32)


@lean
def _with_vectors(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = vectors(batch.column(0).to_pylist())
        listed = pa.ListArray.from_arrays(pa.array(np.arange(0, found.size + 1, LEVELS, dtype=np.int32)), pa.array(found.ravel()))
        yield pa.RecordBatch.from_arrays([*batch.columns, listed], ["word", "n", "vector"])


def upper_nodes(words: DataFrame, cell_words: int) -> frozenset[Node]:
    """Trie nodes above the last level that hold more than ``cell_words`` words; the root is the empty tuple."""
    total = words.count()
    if total <= cell_words:
        return frozenset()
    least = max(cell_words, total // MAX_NODES)
    prefix = F.explode(F.transform(F.sequence(F.lit(1), F.lit(LEVELS - 1)), lambda d: F.slice("vector", F.lit(1), d))).alias("node")
    rows = words.select(prefix).groupBy("node").count().filter(F.col("count") > least).select("node").collect()
    return frozenset([(), *(tuple(r[0]) for r in rows)])


def cells_of(vector: Node, upper: frozenset[Node]) -> tuple[Node, list[Node]]:
    """The word's own cell, and all cells that are reached with a surplus and a deficit of one."""
    depth = 0
    while vector[:depth] in upper:
        depth += 1
    reached = []

    def search(node: Node, surplus: int, deficit: int) -> None:
        if node not in upper:
            reached.append(node)
            return
        own = vector[len(node)]
        search((*node, own), surplus, deficit)
        if surplus:
            search((*node, own + 1), surplus - 1, deficit)
        if deficit and own:
            search((*node, own - 1), surplus, deficit - 1)

    search((), 1, 1)
    return vector[:depth], reached


@lean
def _dealt(batches: Iterable[pa.RecordBatch], upper: frozenset[Node]) -> Iterator[pa.RecordBatch]:
    known: dict[Node, tuple[Node, list[Node]]] = {}
    deepest = max(map(len, upper), default=-1) + 1
    for batch in batches:
        at, cell, leaf = [], [], []
        found = np.asarray(batch.column("vector").values).reshape(-1, LEVELS)[:, :deepest].tolist()
        for i, vector in enumerate(map(tuple, found)):
            if vector not in known:
                known[vector] = cells_of(vector, upper)
            own, reached = known[vector]
            for node in reached:
                at.append(i)
                cell.append(node)
                leaf.append(node == own)
        rows = pa.array(at, pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(cell, pa.list_(pa.int32())), batch.column(0).take(rows), batch.column(1).take(rows), pa.array(leaf, pa.bool_())], ["cell", "word", "n", "leaf"])


def candidates(leaves: np.ndarray, queries: np.ndarray, level: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(query, leaf) numbers of distinct vectors within the budget, by a depth-first search from a level on.

    Rows of ``leaves`` are sorted and agree before ``level``; what queries spend there is counted first.
    """
    surplus = np.maximum(leaves[0, :level] - queries[:, :level], 0).sum(axis=1)
    deficit = np.maximum(queries[:, :level] - leaves[0, :level], 0).sum(axis=1)
    live = np.flatnonzero((surplus <= 1) & (deficit <= 1))
    stack = [(0, len(leaves), level, live, surplus[live], deficit[live])]
    while stack:
        low, high, level, live, surplus, deficit = stack.pop()
        if not len(live):
            continue
        if high - low == 1:
            # One leaf: the rest of its way at once.
            change = leaves[low, level:] - queries[live, level:]
            stays = (surplus + np.maximum(change, 0).sum(axis=1) <= 1) & (deficit - np.minimum(change, 0).sum(axis=1) <= 1)
            yield live[stays], np.full(int(stays.sum()), low)
            continue
        counts = leaves[low:high, level]
        cuts = [low, *(np.flatnonzero(np.diff(counts)) + low + 1).tolist(), high]
        own = queries[live, level]
        for begin, end in zip(cuts[:-1], cuts[1:], strict=True):
            change = int(leaves[begin, level]) - own
            more, fewer = surplus + np.maximum(change, 0), deficit - np.minimum(change, 0)
            stays = (more <= 1) & (fewer <= 1)
            stack.append((begin, end, level + 1, live[stays], more[stays], fewer[stays]))


class Halves:
    """Hashes of the words' first and last halves, by their own length and by that less one.

    If one edit leads from a word to another, at most one of the shorter one's halves is changed, so one stands in both words.
    """

    def __init__(self, codes: np.ndarray, begins: np.ndarray, sizes: np.ndarray):
        self.sizes = sizes
        power = np.full(len(codes) + 1, BASE, np.uint64)
        back = np.full(len(codes) + 1, pow(BASE, -1, 1 << 64), np.uint64)
        power[0] = back[0] = 1
        power, back = np.cumprod(power), np.cumprod(back)
        total = np.r_[np.uint64(0), np.cumsum((codes.astype(np.uint64) + np.uint64(1)) * power[:-1])]
        part = lambda low, high: (total[high] - total[low]) * back[low]
        ends = begins + sizes
        half = np.stack([sizes // 2, np.maximum(sizes - 1, 0) // 2], axis=1)
        self.first, self.last = part(begins[:, None] + 0 * half, begins[:, None] + half), part(ends[:, None] - half, ends[:, None] + 0 * half)

    def shared(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Which pairs of words have a half of the shorter one in common; lengths differ by one at most."""
        longer = self.sizes[a] - self.sizes[b]
        own, other = 2 * a + (longer > 0), 2 * b + (longer < 0)
        first, last = self.first.ravel(), self.last.ravel()
        return (first[own] == first[other]) | (last[own] == last[other])


def one_edit(codes: np.ndarray, begins: np.ndarray, sizes: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which pairs of words differ by exactly one edit; lengths differ by one at most."""
    near = np.zeros(len(a), bool)
    by_size = np.argsort(sizes[a], kind="stable")
    at = 0
    while at < len(a):
        # As many pairs as fit by the longest of them.
        width = sizes[a[by_size[at:]]] + 1
        fit = max(1, int(np.searchsorted(width * np.arange(1, len(width) + 1), COMPARED)))
        rows = by_size[at : at + fit]
        at += fit
        x, y = a[rows], b[rows]
        column = np.arange(int(sizes[x].max()) + 1)
        last = len(codes) - 1
        same_front = codes[np.minimum(begins[x][:, None] + column, last)] == codes[np.minimum(begins[y][:, None] + column, last)]
        same_back = codes[np.maximum((begins + sizes)[x][:, None] - 1 - column, 0)] == codes[np.maximum((begins + sizes)[y][:, None] - 1 - column, 0)]
        shorter = np.minimum(sizes[x], sizes[y])
        same_front &= column < shorter[:, None]
        same_back &= column < shorter[:, None]
        front, back = np.argmin(same_front, axis=1), np.argmin(same_back, axis=1)
        equal = sizes[x] == sizes[y]
        near[rows] = np.where(equal, front + back == sizes[x] - 1, front + back >= shorter)
    return near


FOUND = "word string, n_near long, best struct<minus:bigint,word:string>"
_BEST = pa.struct([("minus", pa.int64()), ("word", pa.string())])


def _search(rows: pa.Table) -> pa.Table:
    """Near words within a cell: for each query their number and the best one."""
    rows = rows.combine_chunks()
    is_leaf = np.asarray(rows["leaf"])
    words, n = rows["word"].to_pylist(), np.asarray(rows["n"])
    leaf_at = np.flatnonzero(is_leaf)
    depth = len(rows["cell"][0])
    near_count = np.zeros(len(words), np.int64)
    best = np.full(len(words), -1)
    if len(leaf_at):
        # Leaf words by number of occurrences, then by code points: the first near one is the best.
        by = np.array(sorted(leaf_at.tolist(), key=list(zip((-n).tolist(), words, strict=True)).__getitem__))
        place = np.empty(len(words), np.int64)
        place[by] = np.arange(len(by))
        best_place = np.full(len(words), len(words))
        codes, sizes = letters(words)
        begins = np.cumsum(sizes) - sizes
        halves = Halves(codes, begins, sizes)
        counted = vectors(words)
        leaves, leaf_rows, leaf_ends = distinct(counted[leaf_at])
        queries, query_rows, query_ends = distinct(counted)
        for q, w in _grouped(candidates(leaves, queries, depth), np.diff(np.r_[0, query_ends]), np.diff(np.r_[0, leaf_ends]), int(sizes.max()) + 1):
            a, b = _expanded(q, w, query_rows, query_ends, leaf_rows, leaf_ends)
            for begin in range(0, len(a), COMPARED):
                x, y = a[begin : begin + COMPARED], leaf_at[b[begin : begin + COMPARED]]
                some = halves.shared(x, y)
                x, y = x[some], y[some]
                near = one_edit(codes, begins, sizes, x, y)
                x, y = x[near], y[near]
                near_count += np.bincount(x, minlength=len(words))
                np.minimum.at(best_place, x, place[y])
        hit = best_place < len(words)
        best[hit] = by[best_place[hit]]
    hits = np.flatnonzero(best >= 0)
    found = pa.StructArray.from_arrays([pa.array(-n[best[hits]]), rows["word"].combine_chunks().take(pa.array(best[hits]))], fields=list(_BEST))
    return pa.table([rows["word"].take(pa.array(hits)), pa.array(near_count[hits]), found], names=["word", "n_near", "best"])


def distinct(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct rows in order, all rows' numbers in that order, and where those of each end."""
    order = np.lexsort(rows.T[::-1])
    new = np.r_[True, (rows[order[1:]] != rows[order[:-1]]).any(axis=1)]
    return rows[order[new]], order, np.r_[np.flatnonzero(new)[1:], len(rows)]


def _grouped(pairs: Iterator, query_sizes: np.ndarray, leaf_sizes: np.ndarray, width: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of vectors, as many together as make about COMPARED letters of words."""
    held, size = [], 0
    for q, w in pairs:
        if len(q):
            held.append((q, w))
            size += int((query_sizes[q] * leaf_sizes[w]).sum()) * width
            if size >= COMPARED:
                yield tuple(np.concatenate(x) for x in zip(*held, strict=True))
                held, size = [], 0
    if held:
        yield tuple(np.concatenate(x) for x in zip(*held, strict=True))


def _expanded(q, w, query_rows, query_ends, leaf_rows, leaf_ends) -> tuple[np.ndarray, np.ndarray]:
    """All (query word, leaf word) of pairs of vectors."""
    n_q, n_w = np.diff(np.r_[0, query_ends])[q], np.diff(np.r_[0, leaf_ends])[w]
    total = n_q * n_w
    pair = np.repeat(np.arange(len(q)), total)
    nth = np.arange(len(pair)) - np.repeat(np.cumsum(total) - total, total)
    return query_rows[(query_ends[q] - n_q)[pair] + nth // n_w[pair]], leaf_rows[(leaf_ends[w] - n_w)[pair] + nth % n_w[pair]]


def words_of(text: Column) -> Column:
    """The maximal runs of letters, A-Z in lower case."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.regexp_extract_all(F.translate(text, upper, upper.lower()), F.lit("[a-zÀ-ÿ]+"), F.lit(0))


def vocabulary(words: DataFrame, min_letters: int = MIN_LETTERS, min_count: int = MIN_COUNT) -> DataFrame:
    """(word, n): distinct words of ``words(word)`` that are long and frequent enough."""
    long = words.select(F.col("word").cast("string").alias("word")).filter(F.length("word") >= min_letters)
    return long.groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= min_count)


def near_words(counted: DataFrame, cell_words: int = CELL_WORDS) -> DataFrame:
    """(word, n_near, best) of the words of ``counted(word, n, vector)`` that have near words; ``best.word`` is the most frequent."""
    upper = upper_nodes(counted, cell_words)
    dealt = counted.mapInArrow(lambda batches: _dealt(batches, upper), "cell array<int>, word string, n long, leaf boolean")
    found = dealt.groupBy("cell").applyInArrow(_search, FOUND)
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min("best").alias("best"))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of ``forms(word, form)``: the last word reached; a word has one form at most, and ways don't meet themselves."""
    way = written(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        ahead = way.select(F.col("word").alias("root"), F.col("root").alias("next"))
        step = written(way.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        way = step.select("word", "root")
        if step.filter("moved").isEmpty():
            return way


def group_variants(words: DataFrame, cell_words: int = CELL_WORDS, lead: int = LEAD) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of a vocabulary ``words(word, n)``.

    ``n_near`` counts a word's near words. ``form`` is the one of largest n (ties: first by code points) if that is at least ``lead``
    times the word's own, ``root`` where forms lead to; a word without a form is its own root.
    """
    kept = words.filter("word is not null").groupBy("word").agg(F.sum("n").alias("n"))
    counted = written(kept.mapInArrow(_with_vectors, "word string, n long, vector array<int>"), "vocabulary")
    near = counted.select("word", "n").join(near_words(counted, cell_words), "word", "left")
    better = -F.col("best.minus") >= lead * F.col("n")
    formed = written(near.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(better, F.col("best.word")).alias("form"), F.when(better, -F.col("best.minus")).alias("form_n")), "forms")
    ends = roots(formed.filter("form is not null").select("word", "form"))
    return formed.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
