"""As-of and interval joins between samples, maintenance stops and cycles.

A maintenance log with few rows (counted first, as far as that number) is broadcast as intervals in cells of equal
numbers: their borders stand at quantiles of each station's stops, so a burst or an outlying stop changes nothing. A
sample finds its cell by a binary search in the borders of its station, and its interval by an equi-join on station
and cell. Beyond that, and for cycles, rows of both sides are put on one time line for each (station, time
chunk), and a window carries the value along; what was carried into a chunk is worked out from one
row per chunk. So a station's whole time line never has to fit one task.

A null station or time meets nothing in either form. A column of the input that has the name of a
result's column is replaced, as ``withColumn`` does; other names never clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import div

#: Log rows that are broadcast; larger logs take the time-line form.
BROADCAST_ROWS = 100_000
CHUNK_MS = 8 * 3600 * 1000


def maintenance_intervals(maintenance: DataFrame) -> DataFrame:
    """(station, fresh, until): from the end of a stop to the end of the next one; negative ends count as none."""
    ends = maintenance.select("station", (F.col("ts_ms") + F.col("duration_ms")).alias("fresh")).filter("fresh >= 0 and station is not null")
    return ends.withColumn("until", F.lead("fresh").over(Window.partitionBy("station").orderBy("fresh")))


def _chunk(ts):
    return F.floor(ts / F.lit(CHUNK_MS)).cast("long")


def _carried(left: DataFrame, marks: DataFrame, forward: bool) -> DataFrame:
    """Left rows with ``mark``: the nearest mark of the station at or before ``at`` (forward: at or after).

    ``left`` has (station, at, row), ``marks`` (station, at).
    """
    best = F.min if forward else F.max
    per_chunk = marks.groupBy("station", _chunk(F.col("at")).alias("chunk")).agg(best("at").alias("edge"))
    used = left.select("station", _chunk(F.col("at")).alias("chunk")).distinct()
    # One row for each station and chunk: what stands at its entry.
    spans = per_chunk.select("station", "chunk", "edge").unionByName(used.withColumn("edge", F.lit(None).cast("long")))
    spans = spans.groupBy("station", "chunk").agg(best("edge").alias("edge"))
    side = Window.partitionBy("station").orderBy("chunk")
    side = side.rowsBetween(1, Window.unboundedFollowing) if forward else side.rowsBetween(Window.unboundedPreceding, -1)
    entry = spans.withColumn("entry", best("edge").over(side)).filter("entry is not null").select("station", "chunk", "entry")
    line = left.select("station", "at", _chunk(F.col("at")).alias("chunk"), F.lit(None).cast("long").alias("mark"), "row", F.lit(1).alias("kind"))
    none = F.lit(None).cast(left.schema["row"].dataType)
    line = line.unionByName(marks.select("station", "at", _chunk(F.col("at")).alias("chunk"), F.col("at").alias("mark"), none.alias("row"), F.lit(0).alias("kind")))
    order = Window.partitionBy("station", "chunk").orderBy(*((F.desc("at"), "kind") if forward else ("at", "kind"))).rowsBetween(Window.unboundedPreceding, 0)
    carried = line.withColumn("mark", F.last("mark", ignorenulls=True).over(order)).filter("kind = 1")
    return carried.join(entry, ["station", "chunk"], "left").select("row", F.coalesce("mark", "entry").alias("mark"))


#: Cells of a station at most; the search below takes one step for each binary digit.
CELLS = 511
STEPS = [1 << k for k in range(CELLS.bit_length() - 1, -1, -1)]


def _few(maintenance: DataFrame, most: int) -> bool:
    """Whether the log has at most so many rows; no more of them than that are counted."""
    return most > 0 and maintenance.select(F.lit(1)).limit(most + 1).count() <= most


def _cell(borders: Column, at: Column) -> Column:
    """How many of the sorted borders are at or before a time, by binary search; none for a null."""
    return F.aggregate(F.array(*map(F.lit, STEPS)), F.lit(0), lambda n, step: F.when(F.get(borders, n + step - 1) <= at, n + step).otherwise(n))


def _met(samples: DataFrame, spans: DataFrame) -> DataFrame:
    """(_row, _span): each sample with the span of its station that it lies in, if there is one.

    ``spans`` (station, begin, end) are few and don't overlap; without an end one goes on. They are cut into cells of equal
    numbers, so the borders stand at quantiles of each station's spans and a span lies in one cell, however unevenly
    they are spread. A station's borders are one row, in which a sample looks up its cell.
    """
    order = Window.partitionBy("station").orderBy("begin")
    everyone = Window.partitionBy("station")
    size = F.ceil(F.count("*").over(everyone) / CELLS)
    nth = F.row_number().over(order) - 1
    dealt = spans.select("station", "begin", "end", nth.alias("nth"), size.alias("size")).withColumn("cell", (div(F.col("nth"), F.col("size")) + 1).cast("int"))
    # Both uses read the same columns, so that Spark sorts the spans once.
    first = F.when((F.col("nth") % F.col("size") == 0) & (F.col("end").isNull() | (F.col("end") >= F.col("begin"))), F.col("begin"))
    borders = dealt.groupBy(F.col("station").alias("_station")).agg(F.sort_array(F.collect_list(first)).alias("_borders"))
    rows = samples.select(F.struct("*").alias("_row")).join(F.broadcast(borders), F.col("_row.station") == F.col("_station"), "left")
    rows = rows.select("_row", _cell(F.col("_borders"), F.col("_row.ts_ms")).alias("_cell"))
    at, span = F.col("_row.ts_ms"), F.col("_span")
    inside = (F.col("_row.station") == span["station"]) & (F.col("_cell") == span["cell"]) & (at >= span["begin"]) & (span["end"].isNull() | (at < span["end"]))
    return rows.join(F.broadcast(dealt.select(F.struct("station", "begin", "end", "cell").alias("_span"))), inside, "left")


def asof_maintenance(telemetry: DataFrame, maintenance: DataFrame, keep_unmatched: bool = False, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Samples with ``fresh``, the latest end of a stop at or before them on their station.

    Samples before the first stop are dropped (their tool's age is unknown), or have a null
    ``fresh`` with ``keep_unmatched``.
    """
    kept = [c for c in telemetry.columns if c != "fresh"]
    if _few(maintenance, broadcast_rows):
        spans = maintenance_intervals(maintenance).filter("until is null or until > fresh").select("station", F.col("fresh").alias("begin"), F.col("until").alias("end"))
        out = _met(telemetry, spans).select(*(F.col("_row")[c].alias(c) for c in kept), F.col("_span.begin").alias("fresh"))
    else:
        ends = maintenance.select("station", (F.col("ts_ms") + F.col("duration_ms")).alias("at")).filter("at >= 0 and station is not null").distinct()
        rows = telemetry.select("station", F.col("ts_ms").alias("at"), F.struct("*").alias("row"))
        out = _carried(rows, ends, forward=False).select(*(F.col("row")[c].alias(c) for c in kept), F.col("mark").alias("fresh"))
    return out if keep_unmatched else out.filter("fresh is not null")


def _stops(maintenance: DataFrame) -> DataFrame:
    return maintenance.select("station", F.col("ts_ms").alias("begin"), (F.col("ts_ms") + F.col("duration_ms")).alias("end")).filter("end > begin and station is not null")


def _merged_few(maintenance: DataFrame) -> DataFrame:
    """``merged_stops`` of a log with few rows, by one sort of each station's."""
    order = Window.partitionBy("station").orderBy("begin", "end")
    before = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    stops = _stops(maintenance).withColumn("new", F.when(before.isNull() | (F.col("begin") > before), 1).otherwise(0))
    stops = stops.withColumn("island", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return stops.groupBy("station", "island").agg(F.min("begin").alias("begin"), F.max("end").alias("end")).drop("island")


def merged_stops(maintenance: DataFrame, chunk_ms: int = CHUNK_MS) -> DataFrame:
    """(station, begin, end) of stops [ts, ts + duration), overlapping or touching ones merged.

    Stops are sorted by (station, chunk); one row a chunk carries the latest end and the number of
    merged stops to the chunks after it.
    """
    stops = _stops(maintenance).withColumn("chunk", F.floor(F.col("begin") / F.lit(chunk_ms)).cast("long"))
    earlier = Window.partitionBy("station").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    ends = stops.groupBy("station", "chunk").agg(F.max("end").alias("last")).withColumn("reach", F.max("last").over(earlier))
    order = Window.partitionBy("station", "chunk").orderBy("begin", "end")
    before = F.greatest(F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.col("reach"))
    stops = stops.join(ends.select("station", "chunk", "reach"), ["station", "chunk"])
    stops = stops.withColumn("new", F.when(before.isNull() | (F.col("begin") > before), 1).otherwise(0))
    counts = stops.groupBy("station", "chunk").agg(F.sum("new").alias("n")).withColumn("islands", F.coalesce(F.sum("n").over(earlier), F.lit(0)))
    stops = stops.withColumn("island", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0))).join(counts.select("station", "chunk", "islands"), ["station", "chunk"])
    return stops.groupBy("station", (F.col("island") + F.col("islands")).alias("island")).agg(F.min("begin").alias("begin"), F.max("end").alias("end")).drop("island")


def label_stopped(telemetry: DataFrame, maintenance: DataFrame, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Samples with ``stopped``: whether they lie in a stop of their station. No sample is repeated."""
    kept = [c for c in telemetry.columns if c != "stopped"]
    if _few(maintenance, broadcast_rows):
        return _met(telemetry, _merged_few(maintenance)).select(*(F.col("_row")[c].alias(c) for c in kept), F.col("_span").isNotNull().alias("stopped"))
    stops = merged_stops(maintenance)
    rows = telemetry.select("station", F.col("ts_ms").alias("at"), F.struct("*").alias("row"))
    last = _carried(rows, stops.select("station", F.col("begin").alias("at")), forward=False)
    spans = stops.select(F.col("station").alias("on_station"), "begin", "end")
    met = last.join(spans, (F.col("row.station") == F.col("on_station")) & (F.col("mark") == F.col("begin")), "left")
    return met.select(*(F.col("row")[c].alias(c) for c in kept), F.coalesce(F.col("row.ts_ms") < F.col("end"), F.lit(False)).alias("stopped"))


def attach_cycle(telemetry: DataFrame, part_events: DataFrame) -> DataFrame:
    """Samples with ``cycle_end_ms``: the first end of a cycle at or after them, else the station's last one."""
    ends = part_events.select("station", F.col("ts_end_ms").alias("at")).filter("station is not null and at is not null").distinct()
    rows = telemetry.select("station", F.col("ts_ms").alias("at"), F.struct("*").alias("row"))
    found = _carried(rows, ends, forward=True)
    last = ends.groupBy(F.col("station").alias("on_station")).agg(F.max("at").alias("last_end"))
    met = found.join(last, F.col("row.station") == F.col("on_station"))
    return met.select(*(F.col("row")[c].alias(c) for c in telemetry.columns if c != "cycle_end_ms"), F.coalesce("mark", "last_end").alias("cycle_end_ms"))
