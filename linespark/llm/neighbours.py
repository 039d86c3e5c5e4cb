"""Exact top-k by inner product: a Voronoi join of queries and data.

After Lu et al., "Efficient Processing of k Nearest Neighbor Joins using MapReduce" (VLDB 2012),
with bounds for the inner product. Pivots, some of the vectors, split the space into cells.

1. Every data row belongs to the cell of its nearest pivot p. A cell's summary has its number of
   rows, its radius r, its largest norm, and over its rows x the range of x.u and the largest norm
   of what is left of x without it, where u is p's direction.
2. Each query q gets a bound from the summaries alone that its k best scores reach: of each cell one
   row scores q.p, and the others q.p - r|q| at least; the (k + 1)-th largest of these values is the
   bound, as the query's own row may be among them.
3. No row of a cell can score more than q.p + r|q|, than |q| times the largest norm, or than
   the range of x.u allows for q.u plus the product of the norms of what is left. A query is sent
   only to the cells whose least such value reaches its bound. There are ``every`` times fewer
   queries than data, so they are what is replicated; each data row moves once.
4. Cells with many rows are dealt into blocks; a block's data are held, its queries stream by. The k
   best of the blocks are merged by a window with a limit before its shuffle.

The number of pivots grows as the root of the number of rows, up to ``MAX_PIVOTS`` (which bounds what
is sent to all tasks). Of equal vectors only the k + 1 smallest ids can be among anyone's best; the
others are left out before anything is dealt, which loses nothing.

Vectors are turned into integers floor(scale * x); scores are exact integers (64-bit floats where
no sum can pass 2^53, else 64-bit integers).

Defined cases: vectors that are null or hold null or non-finite components, and rows with a null
id, take no part; vectors of different lengths are never compared (the commonest length has
pivots, the others are joined block by block); rows repeated with one id are all the query's own,
and equal rows count once; an empty table gives an empty table; further columns are ignored. Components so large that
scores could pass 64 bits are refused.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import lean, written

SCALE = 256
#: Pivots: a quarter of the root of the number of rows, within these bounds.
MIN_PIVOTS, MAX_PIVOTS = 16, 1024
#: Rows of a block: as many as a cell has on average, within these bounds.
MIN_BLOCK_ROWS, BLOCK_ROWS = 256, 16_384
#: Queries that meet a block at once, and rows looked at together.
QUERY_ROWS, CHUNK_ROWS = 256, 4096
#: Bounds are held against rounding by this share.
SLACK = 1e-9
#: Values that a query's bound is chosen from in a cell; where rows of one id make more necessary, there is no bound.
MOST_BOUNDS = 64


def integer_vectors(df: DataFrame, id_col: str, vector_col: str, scale: int = SCALE) -> DataFrame:
    """(vec_id, v): distinct usable rows with integer components."""
    x = F.col(vector_col)
    usable = df.filter(F.col(id_col).isNotNull() & x.isNotNull() & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))))
    return usable.select(F.col(id_col).cast("long").alias("vec_id"), F.transform(x, lambda c: F.floor(F.lit(float(scale)) * c.cast("double"))).alias("v")).distinct()


def _matrix(column: pa.ListArray) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), len(flat) // max(1, len(column)))


@dataclass(frozen=True)
class Cells:
    """Pivots and the summaries of their cells."""

    pivots: np.ndarray
    rows: np.ndarray | None = None
    reach: np.ndarray | None = None
    norm: np.ndarray | None = None
    low: np.ndarray | None = None
    high: np.ndarray | None = None
    rest: np.ndarray | None = None
    blocks: np.ndarray | None = None

    @property
    def size(self) -> np.ndarray:
        return np.sqrt((self.pivots**2).sum(axis=1))

    def nearest(self, v: np.ndarray) -> np.ndarray:
        return ((self.pivots * self.pivots).sum(axis=1) - 2 * v @ self.pivots.T).argmin(axis=1)

    def least(self, scores: np.ndarray, length: np.ndarray, nth: int) -> np.ndarray:
        """A value that ``nth`` scores of each query reach; ``scores`` are those of the pivots."""
        own = np.where(self.nearest(self.pivots) == np.arange(len(self.pivots)), scores, -np.inf)
        low = scores - length[:, None] * self.reach
        # Rounding must not lift a bound, nor count a pivot twice.
        low = np.repeat(low - SLACK * (np.abs(low) + 1), np.minimum(nth, np.maximum(self.rows - 1, 0)).astype(np.int64), axis=1)
        values = np.concatenate([own, low], axis=1)
        at = values.shape[1] - nth
        return np.full(len(scores), -np.inf) if at < 0 else np.partition(values, at, axis=1)[:, at]

    def most(self, scores: np.ndarray, length: np.ndarray) -> np.ndarray:
        """A value that no score of each query in each cell passes."""
        size = np.maximum(self.size, 1e-300)
        along = scores / size
        left = np.sqrt(np.maximum(0.0, length[:, None] ** 2 - along**2))
        split = np.where(self.size > 0, np.maximum(along * self.low, along * self.high) + left * self.rest, np.inf)
        return np.minimum(scores + length[:, None] * self.reach, np.minimum(length[:, None] * self.norm, split))

    def asked(self, v: np.ndarray, nth: int) -> np.ndarray:
        """Queries x cells: whether a cell can hold one of the query's best ``nth``; all can, if these are too many to look at."""
        if nth > MOST_BOUNDS:
            return np.broadcast_to(self.rows > 0, (len(v), len(self.rows)))
        scores, length = v @ self.pivots.T, np.sqrt((v * v).sum(axis=1))
        slack = SLACK * (length[:, None] * (self.norm + self.size) + 1)
        return (self.most(scores, length) + slack >= self.least(scores, length, nth)[:, None]) & (self.rows > 0)


SUMMARY = ["rows", "reach", "norm", "low", "high", "rest"]


def _summaries(batches: Iterable[pa.RecordBatch], cells: Cells) -> Iterator[pa.RecordBatch]:
    """A row for each cell that the task has met."""
    n = len(cells.pivots)
    out = np.zeros((6, n))
    out[3], out[4] = np.inf, -np.inf
    units = cells.pivots / np.maximum(cells.size, 1e-300)[:, None]
    for batch in batches:
        for at in range(0, batch.num_rows, CHUNK_ROWS):
            v = _matrix(batch.column(1).slice(at, CHUNK_ROWS)).astype(np.float64)
            cell = cells.nearest(v)
            along = (v * units[cell]).sum(axis=1)
            np.add.at(out[0], cell, 1)
            np.maximum.at(out[1], cell, np.sqrt(((v - cells.pivots[cell]) ** 2).sum(axis=1)))
            np.maximum.at(out[2], cell, np.sqrt((v * v).sum(axis=1)))
            np.minimum.at(out[3], cell, along)
            np.maximum.at(out[4], cell, along)
            np.maximum.at(out[5], cell, np.sqrt(((v - along[:, None] * units[cell]) ** 2).sum(axis=1)))
    met = np.flatnonzero(out[0])
    yield pa.RecordBatch.from_arrays([pa.array(met.astype(np.int32)), *(pa.array(x[met]) for x in out)], ["cell", *SUMMARY])


@lean
def _cells(batches: Iterable[pa.RecordBatch], cells: Cells) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            cell = cells.nearest(_matrix(batch.column(1)).astype(np.float64))
            yield pa.RecordBatch.from_arrays([pa.array(cell.astype(np.int32)), pa.array(cells.blocks[cell].astype(np.int32)), batch.column(0), batch.column(1)], ["cell", "blocks", "vec_id", "v"])


@lean
def _asking(batches: Iterable[pa.RecordBatch], cells: Cells, nth: int) -> Iterator[pa.RecordBatch]:
    """A row for each query and block that can hold one of its best ``nth``."""
    for batch in batches:
        for at in range(0, batch.num_rows, QUERY_ROWS):
            part = batch.slice(at, QUERY_ROWS)
            row, cell = np.nonzero(cells.asked(_matrix(part.column(1)).astype(np.float64), nth))
            times = cells.blocks[cell]
            row, cell, block = np.repeat(row, times), np.repeat(cell, times), np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
            yield pa.RecordBatch.from_arrays([pa.array(cell.astype(np.int32)), pa.array(block.astype(np.int32)), part.column(0).take(pa.array(row)), part.column(1).take(pa.array(row))], ["cell", "block", "vec_id", "v"])


def best_of(queries: np.ndarray, query_ids: np.ndarray, data: np.ndarray, data_ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query id, data id, score) of the k best of each query, ties to the smaller id."""
    size = float(np.abs(queries).max(initial=0)) * float(np.abs(data).max(initial=0)) * data.shape[1]
    scores = queries.astype(np.float64) @ data.astype(np.float64).T if size < 2**53 else queries @ data.T
    own = data_ids == query_ids[:, None]
    scores[own] = np.finfo(np.float64).min if scores.dtype == np.float64 else np.iinfo(np.int64).min
    keep = min(k, len(data))
    least = np.partition(scores, len(data) - keep, axis=1)[:, len(data) - keep]
    row, col = np.nonzero((scores >= least[:, None]) & ~own)
    value = scores[row, col].astype(np.int64)
    order = np.lexsort((data_ids[col], -value, row))
    row, col, value = row[order], col[order], value[order]
    first = np.searchsorted(row, row)
    top = np.arange(len(row)) - first < k
    return query_ids[row[top]], data_ids[col[top]], value[top]


@lean
def _solve(batches: Iterable[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (cell, block, whether a query): a block's data are held, its queries stream by."""
    key, data, ids = None, [], []
    for batch in batches:
        cell, block, query = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
        cuts = np.r_[np.flatnonzero(np.r_[True, (cell[1:] != cell[:-1]) | (block[1:] != block[:-1]) | (query[1:] != query[:-1])]), len(cell)] if len(cell) else [0]
        for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
            if key != (cell[lo], block[lo]):
                key, data, ids = (cell[lo], block[lo]), [], []
            rows, own = _matrix(batch.column(4).slice(lo, hi - lo)), batch.column(3).slice(lo, hi - lo).to_numpy()
            if not query[lo]:
                data, ids = [np.concatenate([*data, rows])], [np.concatenate([*ids, own])]
            elif data:
                for at in range(0, len(rows), QUERY_ROWS):
                    found = best_of(rows[at : at + QUERY_ROWS], own[at : at + QUERY_ROWS], data[0], ids[0], k)
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in found], ["query_id", "vec_id", "score"])


KIND = "vec_id long, v array<bigint>"


def _solved(data: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(query_id, vec_id, score): the best of each block; both sides have (cell, block, vec_id, v)."""
    side = lambda df, query: df.select("cell", "block", F.lit(query).alias("query"), "vec_id", "v")
    dealt = side(data, False).unionByName(side(queries, True)).repartition("cell", "block").sortWithinPartitions("cell", "block", "query", "vec_id")
    return dealt.mapInArrow(lambda b: _solve(b, k), "query_id long, vec_id long, score long")


def _block(blocks) -> Column:
    return F.pmod(F.xxhash64("vec_id", F.lit("block")), blocks).cast("int")


def top_k(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 5, every: int = 50, pivots: int | None = None) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best rows for each row whose id is divisible by ``every``."""
    rows = written(integer_vectors(df, id_col, vector_col), "vectors")
    most, width = rows.agg(F.max(F.array_max(F.transform("v", F.abs))), F.max(F.size("v"))).first()
    if (most or 0) ** 2 * (width or 0) >= 1 << 63:
        raise ValueError(f"components up to {most} in {width} dimensions make scores of over 64 bits")
    same = Window.partitionBy("v").orderBy("vec_id")
    data = written(rows.withColumn("nth", F.row_number().over(same)).filter(F.col("nth") <= k + 1).withColumn("width", F.size("v")), "vectors-data")
    queries = rows.filter(F.col("vec_id") % every == 0).withColumn("width", F.size("v"))
    top = data.groupBy("width").count().orderBy(F.desc("count"), "width").first()
    width, n = top if top else (0, 0)
    out = _other_widths(data.filter(F.col("width") != width), queries.filter(F.col("width") != width), k)
    if n:
        own = lambda df: df.filter(F.col("width") == width)
        cells = cells_of(own(data), pivots or min(MAX_PIVOTS, max(MIN_PIVOTS, math.ceil(math.sqrt(n) / 4))), n, width)
        # A query's own rows, one unless rows of its id differ, are left out of its k best.
        alike = rows.groupBy("vec_id").count().agg(F.max("count")).first()[0]
        out = out.unionByName(_solved(*dealt(own(data), own(queries), cells, k + alike), k))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return out.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def cells_of(data: DataFrame, pivots: int, n: int, width: int) -> Cells:
    """Choose pivots by a hash of the id and gather the cells' summaries, a row for each cell."""
    chosen = data.filter("nth = 1").orderBy(F.xxhash64("vec_id"), "vec_id").limit(pivots).select("v").collect()
    cells = Cells(np.array([r[0] for r in chosen], np.float64).reshape(len(chosen), width))
    kind = ", ".join(f"{c} double" for c in SUMMARY)
    parts = data.select("vec_id", "v").mapInArrow(lambda b: _summaries(b, cells), f"cell int, {kind}")
    found = parts.groupBy("cell").agg(*((F.sum if c == "rows" else F.min if c == "low" else F.max)(c).alias(c) for c in SUMMARY)).collect()
    table = np.zeros((len(SUMMARY), len(chosen)))
    for r in found:
        table[:, r[0]] = r[1:]
    held = max(MIN_BLOCK_ROWS, min(BLOCK_ROWS, math.ceil(n / len(chosen))))
    return Cells(cells.pivots, *table, np.ceil(table[0] / held).astype(np.int64))


def dealt(data: DataFrame, queries: DataFrame, cells: Cells, nth: int) -> tuple[DataFrame, DataFrame]:
    """The data rows by cell and block, and the queries by all blocks that they need."""
    own = data.select("vec_id", "v").mapInArrow(lambda b: _cells(b, cells), f"cell int, blocks int, {KIND}").withColumn("block", _block(F.col("blocks")))
    return own, queries.select("vec_id", "v").mapInArrow(lambda b: _asking(b, cells, nth), f"cell int, block int, {KIND}")


def _other_widths(data: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """Vectors of rarer lengths: each query meets all blocks of its length."""
    sizes = data.groupBy(F.col("width").alias("cell")).agg(F.ceil(F.count("*") / BLOCK_ROWS).cast("int").alias("blocks"))
    met = lambda df: df.withColumnRenamed("width", "cell").join(sizes, "cell")
    return _solved(met(data).withColumn("block", _block(F.col("blocks"))), met(queries).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))), k)
