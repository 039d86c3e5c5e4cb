"""State of a station from cycle to cycle: cycles since maintenance, and the hold after a breach."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..schemas import CYCLE_ORDER

ORDER = [*CYCLE_ORDER, "down_ms", "status"]
#: A week: some ten thousand cycles of a station.
CHUNK_MS = 7 * 24 * 3600 * 1000


def _chunk(chunk_ms: int) -> Column:
    return F.floor(F.col("ts_end_ms") / F.lit(chunk_ms)).cast("long")


def _order() -> WindowSpec:
    return Window.partitionBy("station", "chunk").orderBy(*ORDER)


def _marks(numbered: DataFrame) -> DataFrame:
    """(station, chunk, cycles, last_stop, last_breach): places of the last marks within each chunk of numbered cycles."""
    last = lambda c: F.max(F.when(c, F.col("nth")))
    breach = last(F.col("breach")) if "breach" in numbered.columns else F.lit(None).cast("int")
    return numbered.groupBy("station", "chunk").agg(F.count("*").alias("cycles"), last(F.col("down_ms") > 0).alias("last_stop"), breach.alias("last_breach"))


def state_chunks(cycles: DataFrame, chunk_ms: int = CHUNK_MS) -> DataFrame:
    """What later chunks need of each (station, chunk): its cycles, and the places of its last stop and breach (with a boolean ``breach``).

    Stored and extended by new chunks, they stand for the old cycles in ``cycles_since_maintenance`` and ``spc_derate``.
    """
    return _marks(cycles.withColumn("chunk", _chunk(chunk_ms)).withColumn("nth", F.row_number().over(_order())))


def _entries(own: DataFrame, earlier: DataFrame | None) -> DataFrame:
    """(station, chunk, begin, stop_at, breach_at): cycles before each chunk, and the places of the last marks before it."""
    chunks = own if earlier is None else own.unionByName(earlier.select(*own.columns))
    before = Window.partitionBy("station").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    chunks = chunks.withColumn("begin", F.coalesce(F.sum("cycles").over(before), F.lit(0)))
    return chunks.select("station", "chunk", "begin", *(F.max(F.col("begin") + F.col(f"last_{m}")).over(before).alias(f"{m}_at") for m in ("stop", "breach")))


def cycles_since_maintenance(part_events: DataFrame, chunk_ms: int = CHUNK_MS, earlier: DataFrame | None = None) -> DataFrame:
    """Cycles with ``since``: cycles after the last one that ended in a stop; 0 on that one.

    Before a station's first stop it counts from the first cycle. Each station's time line is cut
    into chunks; one row a chunk carries the count across. ``earlier`` are stored ``state_chunks`` of
    cycles that came in chunks before these.
    """
    rows = part_events.withColumn("chunk", _chunk(chunk_ms)).withColumn("nth", F.row_number().over(_order()))
    stop_nth = F.max(F.when(F.col("down_ms") > 0, F.col("nth"))).over(_order().rowsBetween(Window.unboundedPreceding, 0))
    entries = _entries(_marks(rows.drop("breach")), earlier).select("station", "chunk", (F.col("begin") - F.coalesce("stop_at", F.lit(0))).alias("entry"))
    out = rows.withColumn("stop_nth", stop_nth).join(entries, ["station", "chunk"])
    since = F.when(F.col("stop_nth").isNotNull(), F.col("nth") - F.col("stop_nth")).otherwise(F.col("entry") + F.col("nth"))
    return out.withColumn("since", since.cast("long")).drop("chunk", "nth", "stop_nth", "entry")


def with_breaches(cycles: DataFrame, limits: DataFrame, value: str = "torque") -> DataFrame:
    """Cycles with ``breach``: whether their value is above their station's upper limit (never without one)."""
    ucl = limits.select(F.col("station").alias("on_station"), F.col("ucl").alias("upper_limit"))
    cycles = cycles.drop("breach").join(ucl, F.col("station") == F.col("on_station"), "left")
    return cycles.withColumn("breach", F.coalesce(F.col(value) > F.col("upper_limit"), F.lit(False))).drop("on_station", "upper_limit")


def spc_derate(cycles: DataFrame, hold: int = 40, limits: DataFrame | None = None, value: str = "torque", chunk_ms: int = CHUNK_MS, earlier: DataFrame | None = None) -> DataFrame:
    """Cycles with ``derated``: a breach within the last ``hold`` cycles that no stop has reset since.

    ``cycles`` are part events with a boolean ``breach``; with ``limits`` (station, ucl) it is found by ``with_breaches``.
    A stop resets the hold of earlier breaches; a breach on the cycle of the stop counts again. Each station's time
    line is cut into chunks; one row a chunk carries its places, last breach and last stop across. ``earlier`` are
    stored ``state_chunks`` of cycles that came in chunks before these.
    """
    if limits is not None:
        cycles = with_breaches(cycles, limits, value)
    rows = cycles.withColumn("chunk", _chunk(chunk_ms)).withColumn("nth", F.row_number().over(_order()))
    before = _order().rowsBetween(Window.unboundedPreceding, -1)
    marks = {"breach": F.col("breach"), "stop": F.col("down_ms") > 0}
    own = {f"{m}_nth": F.max(F.when(c, F.col("nth"))).over(before) for m, c in marks.items()}
    rows_in = rows.withColumns(own).join(_entries(_marks(rows), earlier), ["station", "chunk"])
    rows_in = rows_in.withColumns({f"{m}_nth": F.coalesce(F.col("begin") + F.col(f"{m}_nth"), F.col(f"{m}_at")) for m in marks}).withColumn("nth", F.col("begin") + F.col("nth"))
    held = (F.col("nth") - F.col("breach_nth") <= hold) & (F.col("stop_nth").isNull() | (F.col("stop_nth") <= F.col("breach_nth")))
    return rows_in.withColumn("derated", F.coalesce(held, F.lit(False))).drop("chunk", "begin", "breach_nth", "stop_nth", "breach_at", "stop_at")
