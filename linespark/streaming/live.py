"""Live checks on streams: breaches per station, signal and window, and the hold after a breach."""

from __future__ import annotations

import itertools
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import BooleanType, StructField, StructType

from ..schemas import CYCLE_ORDER

ROCKS_DB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
#: The order of a station's cycles.
ORDER = [*CYCLE_ORDER, "down_ms", "status"]
#: Cycles sorted together before they reach the state, and the cycles of a piece of it.
RUN_ROWS, PIECE_ROWS = 400_000, 16_384
PIECES = "station string, first_ms long, last_ms long, cycles binary"


def breach_counts(telemetry: DataFrame, limits: DataFrame, window: str = "1 hour", delay: str | None = None) -> DataFrame:
    """(station, signal, window_start_ms, samples, breaches): samples above the upper limit.

    ``limits`` is the small table of control limits, a row for each station and signal. On a
    stream ``delay`` sets the watermark: later rows are dropped, and state is kept for stations
    times open windows only.
    """
    rows = telemetry.withColumn("at", F.timestamp_millis("ts_ms"))
    if delay is not None:
        rows = rows.withWatermark("at", delay)
    met = rows.join(limits.select("station", "signal", "ucl"), ["station", "signal"])
    counts = met.groupBy(F.window("at", window).alias("w"), "station", "signal").agg(F.count("*").alias("samples"), F.count(F.when(F.col("value") > F.col("ucl"), 1)).alias("breaches"))
    return counts.select("station", "signal", F.unix_millis("w.start").alias("window_start_ms"), "samples", "breaches")


def breach_stream(stream: DataFrame, limits: DataFrame, window: str = "1 hour", delay: str = "10 minutes") -> DataFrame:
    """The same on a telemetry stream, for an append sink."""
    return breach_counts(stream, limits, window, delay)


def _bytes_of(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="lz4")) as out:
        out.write_table(table.combine_chunks())
    return sink.getvalue().to_pybytes()


def _table_of(data: bytes) -> pa.Table:
    return pa.ipc.open_stream(pa.py_buffer(bytes(data))).read_all()


def _in_order(table: pa.Table, order: list[str]) -> pa.Table:
    return table.take(pc.sort_indices(table, sort_keys=[(c, "ascending") for c in order], null_placement="at_end")).combine_chunks()


def _pieces(batches: Iterable[pa.RecordBatch], names: list[str], run_rows: int, piece_rows: int) -> Iterator[pa.RecordBatch]:
    """(station, first_ms, last_ms, cycles): pieces of sorted cycles of one station, as Arrow data. Cycles without an end time have no place and are left out."""
    held, n = [], 0
    for batch in _then_none(batches):
        if batch is not None:
            held.append(batch.select(names))
            n += batch.num_rows
        if n >= run_rows or batch is None and n:
            table = pa.Table.from_batches(held)
            held, n = [], 0
            table = _in_order(table.filter(pc.is_valid(table["ts_end_ms"])), ["station", *ORDER])
            if not len(table):
                continue
            station = pc.fill_null(table["station"].combine_chunks().dictionary_encode().indices, -1).to_numpy(zero_copy_only=False)
            edges = [0, *(np.flatnonzero(station[1:] != station[:-1]) + 1).tolist(), len(table)]
            cut = [table.slice(at, min(piece_rows, end - at)) for begin, end in itertools.pairwise(edges) for at in range(begin, end, piece_rows)]
            columns = [x["station"][0].as_py() for x in cut], [x["ts_end_ms"][0].as_py() for x in cut], [x["ts_end_ms"][-1].as_py() for x in cut], [_bytes_of(x) for x in cut]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.int64(), pa.binary()), strict=True)], ["station", "first_ms", "last_ms", "cycles"])


def _then_none(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch | None]:
    yield from batches
    yield None


def _held(breach: np.ndarray, stop: np.ndarray, left: int, hold: int) -> tuple[np.ndarray, int]:
    """For cycles in order whether the hold covers them, and the cycles that it still covers; ``left`` are covered from before."""
    at = np.arange(len(breach))
    last = np.maximum.accumulate(np.where(breach | stop, at, -1))
    before = np.r_[-1, last[:-1]]
    derated = np.where(before < 0, at < left, breach[before] & (at - before <= hold))
    end = last[-1]
    return derated, max(0, left - len(at)) if end < 0 else max(0, hold - int(at[-1] - end)) if breach[end] else 0


class Hold(StatefulProcessor):
    """For each station the cycles that a breach still holds, and the cycles that wait for the watermark.

    Cycles are taken in their order once the watermark has passed them, whatever the order in which they came. They wait
    as sorted pieces, which are merged: of a station's waiting cycles only pieces that overlap in time are held at once. Of a
    station that isn't held and has no waiting cycle, only the time to which it was passed is known; a cycle that comes with an earlier one is dropped.
    """

    def __init__(self, hold: int):
        self.hold = hold

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.left = handle.getValueState("left", "left int")
        self.passed = handle.getValueState("passed", "passed_ms long")
        self.waiting = handle.getMapState("waiting", "first_ms long, last_ms long, nth long", "cycles binary")

    def _keys(self) -> list[tuple[int, int, int]]:
        return sorted(tuple(int(x) for x in key) for key in self.waiting.keys())  # noqa: SIM118

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        passed = self.passed.get()[0] if self.passed.exists() else None
        nth = max((key[2] for key in self._keys()), default=0)
        earliest = None
        for part in rows:
            for first, last, cycles in zip(part["first_ms"].tolist(), part["last_ms"].tolist(), part["cycles"], strict=True):
                if passed is not None and first <= passed:
                    if last <= passed:
                        continue
                    table = _table_of(cycles)
                    table = table.filter(pc.greater(table["ts_end_ms"], passed))
                    first, cycles = table["ts_end_ms"][0].as_py(), _bytes_of(table)
                nth += 1
                self.waiting.updateValue((first, last, nth), (bytes(cycles),))
                earliest = first if earliest is None else min(earliest, first)
        if earliest is not None:
            self.handle.registerTimer(max(earliest, timerValues.getCurrentWatermarkInMs() + 1))
        yield from ()

    def _ready(self, due: list[tuple[int, int, int]], passed: int) -> Iterator[pa.Table]:
        """The cycles of the pieces up to ``passed``, in order; later ones go back to those that wait."""
        held, rest = [], 0
        for key, then in itertools.zip_longest(due, due[1:]):
            table = _table_of(self.waiting.getValue(key)[0])
            self.waiting.removeKey(key)
            if key[1] > passed:
                early = pc.less_equal(table["ts_end_ms"], passed)
                later, table = table.filter(pc.invert(early)), table.filter(early)
                self.waiting.updateValue((later["ts_end_ms"][0].as_py(), key[1], key[2]), (_bytes_of(later),))
            held.append(table)
            # No later piece has a cycle before its first; so many are cut off at once that each is looked at a few times only.
            if then is None or sum(map(len, held)) >= 2 * rest + 4 * PIECE_ROWS:
                table = pa.concat_tables(held)
                final = pc.less(table["ts_end_ms"], then[0]) if then else pa.scalar(True)
                held = [table.filter(pc.invert(final))] if then else []
                rest = sum(map(len, held))
                table = table.filter(final) if then else table
                if len(table):
                    yield _in_order(table, ORDER)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs()
        due = [piece for piece in self._keys() if piece[0] <= passed]
        left = self.left.get()[0] if self.left.exists() else 0
        for ready in self._ready(due, passed):
            breach, stop = (pc.fill_null(x, False).to_numpy() for x in (ready["breach"], pc.greater(ready["down_ms"], 0)))
            derated, left = _held(breach, stop, left, self.hold)
            ready = ready.append_column("derated", pa.array(derated))
            yield pd.DataFrame({"cycles": [_bytes_of(ready.slice(at, PIECE_ROWS)) for at in range(0, len(ready), PIECE_ROWS)]})
        if left:
            self.left.update((left,))
        else:
            self.left.clear()
        if due:
            self.passed.update((passed,))
            if rest := self._keys():
                self.handle.registerTimer(rest[0][0])

    def close(self) -> None:
        pass


def _unpacked(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for cycles in batch.column(0):
            yield from _table_of(cycles.as_py()).to_batches()


def derate_stream(cycles: DataFrame, hold: int = 40, delay: str = "10 minutes") -> DataFrame:
    """Cycles of a stream with ``derated``, as ``spc_derate`` gives it: a breach within the last ``hold`` cycles of the station, and no stop since.

    ``cycles`` are part events with a boolean ``breach``. A cycle that comes when its station has been passed by later than ``delay``
    is dropped. State is kept in a RocksDB store (``run_available`` sets it): two numbers a station, and the cycles of ``delay``.
    Cycles go to the state and come from it as sorted pieces, since Python's state operator handles its rows one by one.
    """
    schema, names, sizes = cycles.schema, cycles.columns, (RUN_ROWS, PIECE_ROWS)
    rows = cycles.withColumn("at", F.timestamp_millis("ts_end_ms")).withWatermark("at", delay)
    pieces = rows.mapInArrow(lambda batches: _pieces(batches, names, *sizes), PIECES)
    held = pieces.groupBy("station").transformWithStateInPandas(Hold(hold), "cycles binary", "Append", "EventTime")
    return held.mapInArrow(_unpacked, StructType([*schema.fields, StructField("derated", BooleanType())]))


def run_available(stream: DataFrame, out: str, checkpoint: str) -> None:
    """Add to the Parquet table ``out`` what the stream gives for all that has arrived; goes on where ``checkpoint`` left off."""
    spark = stream.sparkSession
    before = spark.conf.get(PROVIDER)
    spark.conf.set(PROVIDER, ROCKS_DB)
    try:
        query = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
        query.awaitTermination()
    finally:
        spark.conf.set(PROVIDER, before)
