"""Registered line-analytics queries and their SQL twins, over tables made by ``adapters``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import div
from ..operators import ab, asof, bottleneck, cycles, degradation, filters, kpis, limits, oee, policy, quality, report
from ..sources import lines as text_lines
from ..sources import policies, sinks
from ..sources.shared import fresh_path
from ..streaming import live
from . import adapters, stored

MIN_VALUES = {"torque": 5.0}
BUCKET_S = 1800
NO_IDEAL = "S05"
SPLIT_DAYS, SCORED_DAYS = 1000, 6000
START_DATE, SHIFT_DAYS = "2024-01-01", 59200
SIGMAS, RISES = [2.0, 3.0], [0.1, 0.15, 0.2]

Query = Callable[[SparkSession, str], DataFrame]


def _r(df: DataFrame, **digits: int) -> DataFrame:
    """Round the named columns, so that sums of floats in another order compare equal."""
    return df.withColumns({c: F.round(c, n) for c, n in digits.items()})


def _curve(spark: SparkSession, d: str) -> DataFrame:
    return degradation.degradation(adapters.telemetry(spark, d), adapters.maintenance(spark, d), "torque", BUCKET_S, 5.0)


def _slopes(spark: SparkSession, d: str) -> DataFrame:
    return degradation.degradation_slopes(_curve(spark, d))


def _oee(spark: SparkSession, d: str) -> DataFrame:
    return oee.oee(adapters.part_events(spark, d), adapters.ideal_cycles(spark))


def _bottleneck(spark: SparkSession, d: str) -> DataFrame:
    return bottleneck.bottleneck(adapters.part_events(spark, d))


def _torque(spark: SparkSession, d: str) -> DataFrame:
    """Torque's spread and wear by one pass over the samples."""
    return _r(degradation.limits_and_slopes(adapters.telemetry(spark, d), adapters.maintenance(spark, d), "torque", BUCKET_S, 5.0), mean=10, sd=10)


def _policy_b(spark: SparkSession, d: str) -> DataFrame:
    return policy.synthesise_policy(adapters.base_policy(spark), _torque(spark, d), _bottleneck(spark, d))


def _scored(spark: SparkSession, d: str) -> DataFrame:
    events = adapters.part_events(spark, d)
    # The start is one row, met by every event; no job of its own is run for it.
    start = events.agg(F.min("ts_end_ms").alias("start_ms"))
    return filters.score_window(events.crossJoin(F.broadcast(start)), SPLIT_DAYS, F.col("start_ms")).drop("start_ms")


def _station_kpis(spark: SparkSession, d: str) -> DataFrame:
    events = _scored(spark, d).withColumn("run", F.concat_ws("-", "arm", F.col("seed").cast("string")))
    stops = adapters.maintenance(spark, d).withColumn("run", F.concat_ws("-", "arm", F.col("seed").cast("string")))
    return kpis.station_kpis(events, stops, adapters.ideal_cycles(spark), kpis.horizon(SCORED_DAYS))


def _line_kpis(spark: SparkSession, d: str) -> DataFrame:
    return kpis.line_kpis(_station_kpis(spark, d), SCORED_DAYS)


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    runs = _line_kpis(spark, d).withColumns({"arm": F.split("run", "-")[0], "seed": F.split("run", "-")[1].cast("long")})
    return ab.pair_arms(runs)


def _ci(spark: SparkSession, d: str) -> DataFrame:
    return ab.paired_ci(_pairs(spark, d))


OEE_DIGITS = {"oee": 4, "availability": 4, "performance": 4, "quality": 4, "defect_rate": 5}
LIMIT_DIGITS = {"mean": 4, "sd": 4, "lcl": 4, "ucl": 4}
#: Before the rounding proper: merged means may miss a half by their last bits.
CLOSE = {c: 10 for c in LIMIT_DIGITS}
BOTT_DIGITS = {"utilisation": 4, "idle_s": 1, "blocked_s": 1, "starved_s": 1, "mean_cycle_s": 3}
TABLE_DIGITS = {"oee": 4, "availability": 4, "performance": 4, "quality": 4, "defect_rate": 5, "utilisation": 4, "mean_cycle_s": 3, "blocked_s": 1, "starved_s": 1, "torque_mean": 4, "torque_sd": 4, "slope_per_h": 4, "fresh_torque": 3}
CI_DIGITS = {"a_mean": 6, "b_mean": 6, "delta_mean": 6, "delta_ci95": 5, "delta_pct": 4}


def control_limits(spark, d):
    return _r(limits.control_limits(adapters.telemetry(spark, d), None, 3.0, MIN_VALUES), **LIMIT_DIGITS)


def control_limits_partials(spark, d):
    parts = limits.moment_partials(adapters.telemetry(spark, d).withColumn("part", F.pmod("ts_ms", F.lit(7))), ["part"], None, MIN_VALUES)
    return _r(_r(limits.moment_merge(parts), **CLOSE), **LIMIT_DIGITS)


def oee_query(spark, d):
    return _r(_oee(spark, d), **OEE_DIGITS)


def oee_fallback_ideal(spark, d):
    return _r(oee.oee(adapters.part_events(spark, d), adapters.ideal_cycles(spark, NO_IDEAL)), **OEE_DIGITS)


def oee_partials(spark, d):
    return _r(oee.oee_merge(oee.oee_partials(adapters.part_events(spark, d)), adapters.ideal_cycles(spark)), **OEE_DIGITS)


def bottleneck_query(spark, d):
    return _r(_bottleneck(spark, d), **BOTT_DIGITS)


def longest_blocked_run(spark, d):
    return bottleneck.longest_blocked_run(adapters.part_events(spark, d))


def longest_blocked_run_chunked(spark, d):
    return bottleneck.longest_blocked_run_chunked(adapters.part_events(spark, d), 90 * 24 * 3600 * 1000)


def asof_maintenance(spark, d):
    return asof.asof_maintenance(adapters.telemetry(spark, d), adapters.maintenance(spark, d)).select("ts_ms", "station", "signal", "value", "fresh")


def asof_maintenance_large(spark, d):
    return asof.asof_maintenance(adapters.telemetry(spark, d), adapters.maintenance(spark, d), broadcast_rows=0).select("ts_ms", "station", "signal", "value", "fresh")


def degradation_query(spark, d):
    return _r(_curve(spark, d), age_h=2, mean=4, sd=4)


def fitted_buckets(spark, d):
    return _r(filters.fitted_buckets(_curve(spark, d)), age_h=2, mean=4, sd=4)


def degradation_slopes(spark, d):
    return _r(_slopes(spark, d), slope_per_h=4, intercept=3)


def degradation_points(spark, d):
    return _r(degradation.degradation_points(_curve(spark, d), _slopes(spark, d)), age_h=2, mean_torque=4, sd=4, rise_pct=2)


def find_fastest_wear(spark, d):
    return _r(degradation.find_fastest_wear(_slopes(spark, d)), slope_per_h=4)


def label_stopped(spark, d):
    return asof.label_stopped(adapters.telemetry(spark, d), adapters.maintenance(spark, d)).select("ts_ms", "station", "signal", "value", "stopped")


def label_stopped_large(spark, d):
    return asof.label_stopped(adapters.telemetry(spark, d), adapters.maintenance(spark, d), broadcast_rows=0).select("ts_ms", "station", "signal", "value", "stopped")


def _view_cycles(spark, d):
    return adapters.telemetry(spark, d).filter("signal = 'motor_temp'").select(F.col("ts_ms").alias("ts_end_ms"), "station")


def attach_cycle(spark, d):
    return asof.attach_cycle(filters.filter_signal(adapters.telemetry(spark, d), "torque"), _view_cycles(spark, d)).select("ts_ms", "station", "value", "cycle_end_ms")


def cycles_since_maintenance(spark, d):
    counted = cycles.cycles_since_maintenance(adapters.part_events(spark, d), 90 * 24 * 3600 * 1000)
    return counted.groupBy("station", "since").agg(F.count("*").alias("n"), F.sum("cycle_ms").alias("cycle_ms"), F.sum("part_id").alias("part_ids"))


def spc_derate(spark, d):
    marked = adapters.part_events(spark, d).withColumn("breach", F.col("cycle_ms") >= 17600)
    held = cycles.spc_derate(marked, 40)
    return held.groupBy("station", "derated").agg(F.count("*").alias("n"), F.sum("nth").alias("places"), F.sum("part_id").alias("part_ids"))


def station_kpis(spark, d):
    return _station_kpis(spark, d)


def line_kpis(spark, d):
    return _line_kpis(spark, d)


def paired_ci(spark, d):
    return _r(_ci(spark, d), **CI_DIGITS)


def ab_table(spark, d):
    return _r(ab.ab_table(_ci(spark, d)), a_mean=3, b_mean=3, delta_mean=3, delta_ci95=3, delta_pct=2, ci_pct=2)


def find_constraint(spark, d):
    return _r(bottleneck.find_constraint(_bottleneck(spark, d)), utilisation=4)


def station_table(spark, d):
    cycles_of = bottleneck.oee_and_bottleneck(adapters.part_events(spark, d), adapters.ideal_cycles(spark))
    table = policy.station_table_of(adapters.base_policy(spark), cycles_of, _torque(spark, d))
    return _r(table, **TABLE_DIGITS)


def time_split(spark, d):
    return _r(bottleneck.time_split(_bottleneck(spark, d)), share=4, hours=3)


def pivot_time_split(spark, d):
    return _r(bottleneck.pivot_time_split(bottleneck.time_split(_bottleneck(spark, d))), busy=4, blocked=4, starved=4)


def melt_oee(spark, d):
    return _r(oee.melt_oee(_oee(spark, d)), value=4)


def synthesise_policy(spark, d):
    return _r(_policy_b(spark, d).drop("policy_id", "provenance"), torque_lcl=2, torque_ucl=2)


def policy_grid(spark, d):
    grid = policy.policy_grid(adapters.base_policy(spark), _torque(spark, d), _bottleneck(spark, d), None, SIGMAS, RISES)
    return _r(grid, torque_lcl=2, torque_ucl=2)


def policy_diff(spark, d):
    return _r(policy.policy_diff(adapters.base_policy(spark), _policy_b(spark, d)), A=2, B=2)


def pivot_policy(spark, d):
    return _r(policy.pivot_policy(policy.policy_diff(adapters.base_policy(spark), _policy_b(spark, d))), torque_lcl=2, torque_ucl=2)


def stack_policies(spark, d):
    return _r(policy.stack_policies(adapters.base_policy(spark), _policy_b(spark, d)), torque_lcl=2, torque_ucl=2)


def validate_kpis(spark, d):
    """OEE over the observed span against that over the planned horizon."""
    events = adapters.part_events(spark, d).withColumn("run", F.lit("all"))
    truth = kpis.station_kpis(events, None, adapters.ideal_cycles(spark), kpis.horizon(3 * SCORED_DAYS))
    return _r(report.validate_kpis(_oee(spark, d), truth, ["oee", "availability", "performance", "quality"]), mined=4, truth=4)


def diff_outputs(spark, d):
    """Rows in which the two arms' cycles differ as multisets."""
    shown = adapters.part_events(spark, d).select("station", "cycle_ms", "blocked_ms", "status", "arm")
    a, b = (shown.filter(F.col("arm") == x).drop("arm") for x in "AB")
    return report.diff_outputs(a, b).groupBy("station", "cycle_ms", "blocked_ms", "status", "side").agg(F.count("*").alias("n"))


def filter_bias(spark, d):
    aged = asof.asof_maintenance(filters.filter_signal(adapters.telemetry(spark, d), "torque"), adapters.maintenance(spark, d))
    return _r(limits.filter_bias(aged, 5.0, BUCKET_S), sd_running=4, sd_all=4, slope_running=4, slope_all=4, slope_ratio=2)


def _lines(spark, d):
    return adapters.lines(spark, d).withColumn("fields", F.split("value", ",", -1)).withColumnRenamed("value", "line")


def count_per_station(spark, d):
    return quality.count_per_station(_lines(spark, d))


def quality_report(spark, d):
    return _r(quality.quality_report(quality.classify_limits(_lines(spark, d), "torque", 5.0)), other_signal_pct=3)


def quality_degradation(spark, d):
    found = quality.classify_degradation(_lines(spark, d), adapters.maintenance(spark, d), "torque", 5.0)
    return _r(quality.quality_report(found), other_signal_pct=3)


def assign_shift_day(spark, d):
    return filters.assign_shift_day(adapters.telemetry(spark, d), START_DATE, SHIFT_DAYS).groupBy(F.col("dt").cast("string").alias("dt"), "station").agg(F.count("*").alias("n"))


def score_window(spark, d):
    return _scored(spark, d).groupBy("arm", "seed", "station").agg(F.count("*").alias("n"), F.min("ts_end_ms").alias("first_ms"))


def kv_round_trip(spark, d):
    rows = text_lines.parse_kv_rows(sinks.to_kv_text(_oee(spark, d), "oee"))
    return rows.select(F.col("key").alias("station"), *(F.col("values")[n].cast("double").alias(n) for n in ("parts", "good", "oee", "quality", "min_cycle_s", "down_s")))


def breach_counts(spark, d):
    narrow = limits.control_limits(adapters.telemetry(spark, d), None, 1.0)
    return live.breach_counts(adapters.telemetry(spark, d), narrow)


def _stored_lines(spark, lines: DataFrame, name: str) -> str:
    """Write raw lines in folders by month and by their own station, as runs are stored; the path."""
    path, fields = fresh_path(spark, name), F.split("value", ",", -1)
    day = F.date_from_unix_date(div(F.get(fields, F.lit(0)).try_cast("long"), 86_400_000).cast("int"))
    lines.select(F.trunc(day, "MM").alias("dt"), F.get(fields, F.lit(1)).alias("station"), "value").write.partitionBy("dt", "station").text(path)
    return path


def read_telemetry(spark, d):
    return text_lines.read_telemetry(spark, _stored_lines(spark, adapters.lines(spark, d), "telemetry")).select("ts_ms", "station", "signal", "value")


def read_part_events(spark, d):
    return text_lines.read_part_events(spark, _stored_lines(spark, adapters.event_lines(spark, d), "part-events")).drop("dt")


def read_maintenance(spark, d):
    path = fresh_path(spark, "maintenance")
    adapters.log_lines(spark, d).write.text(path)
    return text_lines.read_maintenance(spark, path)


def maintenance_log(spark, d):
    return text_lines.ordered_log(adapters.maintenance(spark, d)).select("ts_ms", "station", "event", "duration_ms")


def policy_round_trip(spark, d):
    path = fresh_path(spark, "policy")
    policies.write_policy(_r(_policy_b(spark, d), torque_lcl=2, torque_ucl=2), path)
    return policies.read_policy(spark, path, adapters.base_policy(spark))


def missing_stations(spark, d):
    return policies.missing_stations(adapters.base_policy(spark).filter("station < 'S05'"), adapters.part_events(spark, d))


def ingest_runs(spark, d):
    """Two runs, the first one stored again with one signal only: of its old rows none are left."""
    path = fresh_path(spark, "runs")
    rows = adapters.telemetry(spark, d).withColumn("dt", F.trunc(F.date_from_unix_date(div(F.col("ts_ms"), 86_400_000).cast("int")), "MM"))
    for run, kept in (("a", rows), ("b", rows), ("a", rows.filter("signal = 'vibration'"))):
        sinks.ingest_run(kept, run, path)
    return spark.read.parquet(path).groupBy("run", F.col("dt").cast("string").alias("dt"), "station").agg(F.count("*").alias("n"), F.min("ts_ms").alias("first_ms"))


def summary_round_trip(spark, d):
    path = fresh_path(spark, "summary")
    sinks.write_summary(paired_ci(spark, d), path)
    return spark.read.schema("metric string, n long, a_mean double, b_mean double, delta_mean double, delta_ci95 double, delta_pct double").json(path)


def _event_lines(spark, d):
    return adapters.event_lines(spark, d).withColumn("fields", F.split("value", ",", -1)).withColumnRenamed("value", "line")


def classify_oee(spark, d):
    return quality.quality_report(quality.classify_oee(_event_lines(spark, d)))


def classify_bottleneck(spark, d):
    return quality.quality_report(quality.classify_bottleneck(_event_lines(spark, d)))


def _kv(spark, df: DataFrame, kind: str) -> DataFrame:
    """The mined rows of a job, written as text files and read again."""
    path = fresh_path(spark, f"kv-{kind}")
    sinks.to_kv_text(df, kind).write.text(path)
    rows, values = text_lines.read_kv_rows(spark, path), F.col("values")
    return rows.select(F.col("key").alias("station"), *(values[n].cast("string" if f == "%s" else "double").alias(n) for n, f in sinks.KV_LAYOUTS[kind]))


def kv_bottleneck(spark, d):
    return _kv(spark, _bottleneck(spark, d), "bottleneck")


def kv_limits(spark, d):
    return _kv(spark, limits.control_limits(adapters.telemetry(spark, d), None, 3.0, MIN_VALUES), "limits")


def kv_degradation(spark, d):
    return _kv(spark, _curve(spark, d), "degradation")


def curve_ordered(spark, d):
    return _r(degradation.ordered_curve(_curve(spark, d)), age_h=2, mean=4, sd=4)


def shares_ordered(spark, d):
    return _r(bottleneck.ordered_shares(bottleneck.time_split(_bottleneck(spark, d))), share=4, hours=3)


def spc_derate_limits(spark, d):
    """The hold after cycles above their station's upper limit, here of cycle times at one sigma."""
    events = adapters.part_events(spark, d)
    timed = events.select(F.col("ts_end_ms").alias("ts_ms"), "station", F.lit("cycle_s").alias("signal"), (F.col("cycle_ms") / 1000.0).alias("value"))
    upper = _r(limits.control_limits(timed, None, 1.0), ucl=2)
    held = cycles.spc_derate(events.withColumn("cycle_s", F.col("cycle_ms") / 1000.0), 5, upper, "cycle_s", 90 * 24 * 3600 * 1000)
    return held.groupBy("station", "derated", "breach").agg(F.count("*").alias("n"), F.sum("nth").alias("places"), F.sum("part_id").alias("part_ids"))


def oee_rollup(spark, d):
    return _r(stored.oee_rollup(spark, d), **OEE_DIGITS)


def limits_rollup(spark, d):
    return _r(_r(stored.limits_rollup(spark, d), **CLOSE), **LIMIT_DIGITS)


def slopes_rollup(spark, d):
    return _r(stored.slopes_rollup(spark, d), slope_per_h=4, intercept=3)


def bottleneck_stored(spark, d):
    return _r(stored.bottleneck_stored(spark, d), **BOTT_DIGITS)


def queries() -> dict[str, Query]:
    named = {"oee": oee_query, "bottleneck": bottleneck_query, "degradation": degradation_query}
    same = [
        control_limits, control_limits_partials, oee_fallback_ideal, oee_partials, longest_blocked_run, longest_blocked_run_chunked, asof_maintenance, asof_maintenance_large,
        fitted_buckets, degradation_slopes, degradation_points, find_fastest_wear, label_stopped, label_stopped_large, attach_cycle, cycles_since_maintenance, spc_derate,
        station_kpis, line_kpis, paired_ci, ab_table, find_constraint, station_table, time_split, pivot_time_split, melt_oee, synthesise_policy, policy_grid, policy_diff,
        pivot_policy, stack_policies, validate_kpis, diff_outputs, filter_bias, count_per_station, quality_report, quality_degradation, assign_shift_day, score_window, kv_round_trip, breach_counts,
        read_telemetry, read_part_events, read_maintenance, maintenance_log, policy_round_trip, missing_stations, ingest_runs, summary_round_trip, classify_oee, classify_bottleneck,
        kv_bottleneck, kv_limits, kv_degradation, curve_ordered, shares_ordered, spc_derate_limits,
        oee_rollup, limits_rollup, slopes_rollup, bottleneck_stored, stored.since_stored, stored.derate_stored, stored.diff_fingerprints, stored.mined_counts, stored.ingest_days, stored.score_stored,
        stored.breach_stream, stored.derate_stream,
    ]
    return named | {f.__name__: f for f in same}


def oracle_sql() -> dict[str, str]:
    from .oracles import oracle_sql as found

    return found()
