"""Helpers shared by the training-data operators."""

from __future__ import annotations

import contextlib
import ctypes
import functools
import shutil
import tempfile
from collections.abc import Callable, Iterable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ..sources.shared import fresh_path

_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send the package to the executors' Python, once for each application."""
    app = spark.sparkContext.applicationId
    if app not in _SHIPPED:
        package = Path(__file__).resolve().parents[1]
        spark.sparkContext.addPyFile(shutil.make_archive(f"{tempfile.mkdtemp(prefix='spark-')}/{package.name}", "zip", package.parent, package.name))
        _SHIPPED.add(app)


def shipped(query: Callable) -> Callable:
    """The query, with the package sent ahead."""

    @functools.wraps(query)
    def run(spark: SparkSession, *args):
        ship(spark)
        return query(spark, *args)

    return run


#: Paths made since the innermost ``scratch`` began.
_SCRATCH: list[list[str]] = []


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    path = fresh_path(spark, name)
    if _SCRATCH:
        _SCRATCH[-1].append(path)
    return path


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Delete the tables that are written inside, once the work that reads them is done."""
    _SCRATCH.append([])
    try:
        yield
    finally:
        for path in _SCRATCH.pop():
            remove_path(spark, path)


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back.

    This cuts the lineage and survives lost executors.
    """
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def unwritten(*tables: DataFrame) -> None:
    """Delete tables of ``written`` that are no longer read."""
    for df in tables:
        for path in {file.rsplit("/", 1)[0] for file in df.inputFiles()}:
            remove_path(df.sparkSession, path)


@contextlib.contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Delete the shuffle files of each table written inside as soon as it is there."""
    setting = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(setting)
    spark.conf.set(setting, "true")
    try:
        yield
    finally:
        spark.conf.set(setting, before)


def remove_path(spark: SparkSession, path: str) -> None:
    """Delete a table that is no longer read."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def lean(rows: Callable) -> Callable:
    """A map over record batches that gives freed memory back when its task ends.

    Workers are shared by the stages of a job; without this each keeps its largest task's memory.
    """

    @functools.wraps(rows)
    def run(*args) -> Iterator[pa.RecordBatch]:
        try:
            yield from rows(*args)
        finally:
            pa.default_memory_pool().release_unused()
            with contextlib.suppress(AttributeError, OSError):
                ctypes.CDLL(None).malloc_trim(0)

    return run


def pieces(batches: Iterable[pa.RecordBatch], column: int, max_bytes: int) -> Iterator[pa.RecordBatch]:
    """Cut record batches so that the texts of one piece hold about ``max_bytes`` at most (one row at least)."""
    for batch in batches:
        begin, held = 0, 0
        sizes = _lengths(batch.column(column))
        for i, n in enumerate(sizes):
            if held and held + n > max_bytes:
                yield batch.slice(begin, i - begin)
                begin, held = i, 0
            held += n
        if begin < batch.num_rows:
            yield batch.slice(begin)


class Numbers(dict):
    """Numbers words in the order in which they are first asked for."""

    def __init__(self, first: int = 0):
        self.first = first

    def __missing__(self, word: bytes) -> int:
        self[word] = number = len(self) + self.first
        return number


def joined(batches: Iterable[pa.RecordBatch], column: int, max_bytes: int) -> Iterator[pa.RecordBatch]:
    """Join record batches so that the texts of one hold about ``max_bytes`` (one row at least, and the last what is left)."""
    held, size = [], 0
    for piece in pieces(batches, column, max_bytes // 4):
        n = sum(_lengths(piece.column(column)))
        if held and size + n > max_bytes:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, size = [], 0
        held.append(piece)
        size += n
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def _lengths(array: pa.Array) -> list[int]:
    import pyarrow.compute as pc

    return pc.fill_null(pc.binary_length(array), 0).to_pylist()
