"""Registered queries on stored roll-ups, stored chunks, stored days and streams; each derives what it stores from the given tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import div
from ..operators import bottleneck, cycles, degradation, filters, limits, oee, quality, report
from ..schemas import PART_EVENTS, TELEMETRY
from ..sources import rollups, sinks
from ..sources.shared import fresh_path
from ..streaming import live
from . import adapters

DAY_MS = 86_400_000
#: Chunks of a quarter or so, as the given cycles span seven years; and the first chunk that counts as new.
CHUNK_MS, NEW_CHUNK = 90 * DAY_MS, 118
#: The day (of samples) and the month (of cycles) of which a part comes late.
LATE_DAY, LATE_MONTH = "2024-01-15", "1997-03-01"
BUCKET_S, MIN_TORQUE = 1800, 5.0


def _day(ts: str) -> Column:
    return F.date_from_unix_date(div(F.col(ts), DAY_MS).cast("int"))


def _by_day(rows: DataFrame) -> DataFrame:
    return rows.withColumn("dt", _day("ts_ms"))


def _by_month(events: DataFrame) -> DataFrame:
    return events.withColumn("dt", F.trunc(_day("ts_end_ms"), "MM"))


def _stored_in_two(spark: SparkSession, name: str, rows: DataFrame, late: Column, day: str, partials) -> DataFrame:
    """Partials of all days, first without the late rows; then those of the late day again. Only partials are read back."""
    path = fresh_path(spark, name)
    rollups.store_parts(partials(rows.filter(~late)), path)
    rollups.store_parts(partials(rows.filter(F.col("dt") == F.lit(day).cast("date"))), path)
    return rollups.read_parts(spark, path)


def oee_rollup(spark: SparkSession, d: str) -> DataFrame:
    events = _by_month(adapters.part_events(spark, d))
    late = (F.col("dt") == F.lit(LATE_MONTH).cast("date")) & (F.col("part_id") % 3 == 0)
    return oee.oee_merge(_stored_in_two(spark, "oee-days", events, late, LATE_MONTH, oee.oee_partials), adapters.ideal_cycles(spark))


def _late_sample() -> Column:
    return (F.col("dt") == F.lit(LATE_DAY).cast("date")) & (F.floor("value") % 3 == 0)


def limits_rollup(spark: SparkSession, d: str) -> DataFrame:
    rows = _by_day(adapters.telemetry(spark, d))
    parts = _stored_in_two(spark, "limit-days", rows, _late_sample(), LATE_DAY, lambda r: limits.moment_partials(r, ["dt"], None, {"torque": MIN_TORQUE}))
    return limits.moment_merge(parts)


def slopes_rollup(spark: SparkSession, d: str) -> DataFrame:
    """Slopes from stored days of the curve, fitted from co-moments of each twelve hours of age."""
    rows, log = _by_day(adapters.telemetry(spark, d)), adapters.maintenance(spark, d)
    parts = _stored_in_two(spark, "curve-days", rows, _late_sample(), LATE_DAY, lambda r: degradation.curve_partials(r, log, ["dt"], "torque", BUCKET_S, MIN_TORQUE))
    fitted = filters.fitted_buckets(degradation.curve_merge(parts, BUCKET_S))
    return degradation.slope_merge(degradation.slope_partials(fitted, [F.floor(F.col("age_h") / 12).alias("part")]))


def _old_and_new(events: DataFrame) -> tuple[DataFrame, DataFrame]:
    cut = NEW_CHUNK * CHUNK_MS
    return events.filter(F.col("ts_end_ms") < cut), events.filter(F.col("ts_end_ms") >= cut)


def bottleneck_stored(spark: SparkSession, d: str) -> DataFrame:
    """The constraint's figures from stored chunks, to which the new ones are added."""
    path = fresh_path(spark, "run-chunks")
    for rows in _old_and_new(adapters.part_events(spark, d)):
        rollups.store_parts(bottleneck.run_chunks(rows, CHUNK_MS), path, "chunk")
    return bottleneck.bottleneck_of_chunks(rollups.read_parts(spark, path))


def _breaches(events: DataFrame) -> DataFrame:
    return events.withColumn("breach", F.col("cycle_ms") >= 17600)


def _with_earlier(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """The new cycles, and the stored chunks of the old ones."""
    path = fresh_path(spark, "state-chunks")
    old, new = _old_and_new(_breaches(adapters.part_events(spark, d)))
    rollups.store_parts(cycles.state_chunks(old, CHUNK_MS), path, "chunk")
    return new, rollups.read_parts(spark, path)


def since_stored(spark: SparkSession, d: str) -> DataFrame:
    """Cycles since maintenance of new cycles only; the old ones are known by their stored chunks."""
    new, earlier = _with_earlier(spark, d)
    counted = cycles.cycles_since_maintenance(new, CHUNK_MS, earlier)
    return counted.groupBy("station", "since").agg(F.count("*").alias("n"), F.sum("part_id").alias("part_ids"))


def derate_stored(spark: SparkSession, d: str) -> DataFrame:
    """The hold after a breach of new cycles only."""
    new, earlier = _with_earlier(spark, d)
    held = cycles.spc_derate(new, 40, chunk_ms=CHUNK_MS, earlier=earlier)
    return held.groupBy("station", "derated").agg(F.count("*").alias("n"), F.sum("nth").alias("places"), F.sum("part_id").alias("part_ids"))


def diff_fingerprints(spark: SparkSession, d: str) -> DataFrame:
    """Rows in which a run differs from itself with some cycles left out and some repeated."""
    shown = adapters.part_events(spark, d).select("part_id", "station", "cycle_ms", "status", "arm")
    other = shown.filter("part_id % 500 <> 0").unionByName(shown.filter("part_id % 700 = 0"))
    return report.diff_by_fingerprints(shown, other).groupBy(*shown.columns, "side").agg(F.count("*").alias("n"))


def mined_counts(spark: SparkSession, d: str) -> DataFrame:
    """Classes of the four jobs' lines with their results' sizes and sums; a job scans its lines once for both."""
    split = lambda lines: lines.withColumn("fields", F.split("value", ",", -1)).withColumnRenamed("value", "line")
    events, samples = split(adapters.event_lines(spark, d)), split(adapters.lines(spark, d))
    mined = {
        "oee": (quality.mine_oee(events), lambda t: oee.oee_merge(t).select("good")),
        "bottleneck": (quality.mine_bottleneck(events, CHUNK_MS), lambda t: bottleneck.bottleneck_of_chunks(t).select("longest_blocked_run")),
        "limits": (quality.mine_limits(samples, "torque", MIN_TORQUE), lambda t: limits.moment_merge(t).select("mean")),
        "degradation": (quality.mine_degradation(samples, adapters.maintenance(spark, d), "torque", MIN_TORQUE, BUCKET_S), lambda t: degradation.curve_merge(t, BUCKET_S).select("mean")),
    }
    shown = []
    for job, (table, result) in mined.items():
        path = fresh_path(spark, f"mined-{job}")
        table.write.parquet(path)
        stored = spark.read.schema(table.schema).parquet(path)
        figures = result(quality.mined_rows(stored)).toDF("x").agg(F.count("*").alias("results"), F.round(F.sum(F.col("x").cast("double")), 3).alias("total"))
        shown.append(quality.class_counts(stored).crossJoin(F.broadcast(figures)).select(F.lit(job).alias("job"), "class", "n", "results", "total"))
    return reduce(DataFrame.unionByName, shown)


def ingest_days(spark: SparkSession, d: str) -> DataFrame:
    """A run, of which one day is stored again with one station only; its other days stay, and of the old day none is left."""
    path, rows = fresh_path(spark, "day-runs"), _by_day(adapters.telemetry(spark, d))
    sinks.ingest_run(rows, "a", path)
    sinks.ingest_days(rows.filter((F.col("dt") == F.lit(LATE_DAY).cast("date")) & (F.col("station") == "S02")), "a", path)
    return spark.read.parquet(path).groupBy("run", F.col("dt").cast("string").alias("dt"), "station").agg(F.count("*").alias("n"), F.min("ts_ms").alias("first_ms"))


def score_stored(spark: SparkSession, d: str) -> DataFrame:
    """Cycles of the scored quarters of stored runs; quarters before each run's own start of scoring stay unread."""
    path = fresh_path(spark, "scored-runs")
    events = adapters.part_events(spark, d).withColumn("dt", F.trunc(_day("ts_end_ms"), "QUARTER"))
    for arm in "AB":
        sinks.ingest_run(events.filter(F.col("arm") == arm).drop("arm"), arm, path)
    starts = spark.createDataFrame([("A", "1996-04-01"), ("B", "2000-01-01")], "run string, first string")
    scored = filters.score_stored_days(spark.read.parquet(path), starts.select("run", F.col("first").cast("date").alias("first_dt")))
    return scored.groupBy("run", "station").agg(F.count("*").alias("n"), F.min("ts_end_ms").alias("first_ms"))


def _arrivals(rows: DataFrame, ts: str, parts: int) -> tuple[DataFrame, int, int]:
    """Rows with ``arrival``, equal stretches of their time numbered from 0; the first time and a stretch's length."""
    low, high = rows.agg(F.min(ts), F.max(ts)).first()
    if low is None:
        low = high = 0
    step = (high - low) // parts + 1
    return rows.withColumn("arrival", div(F.col(ts) - F.lit(low), step)), low, step


def _arrive(rows: DataFrame, schema: str, path: str) -> None:
    rows.select(*(f.split()[0] for f in schema.split(", "))).write.mode("append").parquet(path)


def breach_stream(spark: SparkSession, d: str) -> DataFrame:
    """The live check over four arrivals, each a run of its own that goes on from the checkpoint; late samples come after their windows are closed."""
    telemetry = adapters.telemetry(spark, d)
    path = {name: fresh_path(spark, f"live-{name}") for name in ("in", "limits", "checkpoint", "out")}
    limits.control_limits(telemetry, None, 1.0).write.parquet(path["limits"])
    upper = spark.read.parquet(path["limits"])
    rows, low, step = _arrivals(telemetry, "ts_ms", 3)
    late = (F.col("ts_ms") < low + step // 2) & (F.floor("value") % 5 == 0)
    # A sample far in the future closes the windows before it.
    last = spark.createDataFrame([(low + 100 * step + 10 * DAY_MS, "S01", "torque", 0.0)], TELEMETRY)
    for arrived in (rows.filter((F.col("arrival") == 0) & ~late), rows.filter("arrival = 1"), rows.filter((F.col("arrival") == 2) | late), last):
        _arrive(arrived, TELEMETRY, path["in"])
        stream = spark.readStream.schema(TELEMETRY).parquet(path["in"])
        live.run_available(live.breach_stream(stream, upper), path["out"], path["checkpoint"])
    return spark.read.schema("station string, signal string, window_start_ms long, samples long, breaches long").parquet(path["out"])


def derate_stream(spark: SparkSession, d: str) -> DataFrame:
    """The hold after a breach, kept as state over four arrivals of cycles."""
    fields = f"{PART_EVENTS}, breach boolean"
    rows, low, step = _arrivals(_breaches(adapters.part_events(spark, d)), "ts_end_ms", 3)
    path = {name: fresh_path(spark, f"hold-{name}") for name in ("in", "checkpoint", "out")}
    last = spark.createDataFrame([(low + 100 * step, "", 0, 0, 0, 0, 0, "", "", False)], fields)
    for arrived in (*(rows.filter(F.col("arrival") == i) for i in range(3)), last):
        _arrive(arrived, fields, path["in"])
        stream = spark.readStream.schema(fields).parquet(path["in"])
        live.run_available(live.derate_stream(stream, 40), path["out"], path["checkpoint"])
    held = spark.read.schema(f"{fields}, derated boolean").parquet(path["out"])
    return held.groupBy("station", "derated").agg(F.count("*").alias("n"), F.sum("part_id").alias("part_ids"))
