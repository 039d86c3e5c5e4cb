"""Operators on small hand-made rows and random ones against plain loops."""

import random

import pytest
from pyspark.sql import functions as F

from linespark.operators import ab, asof, bottleneck, cycles, degradation, filters, kpis, limits, oee, policy, report
from linespark.plans import adapters
from linespark.sources import lines
from linespark.schemas import MAINTENANCE, PART_EVENTS, TELEMETRY

# Figures of a seven-day run and the policy that follows from them.
MINED = [
    ("S01", 29.0222, 1.2615, 0.7002, 11.305, 0.151879, 28.05174), ("S02", 47.2276, 3.0046, 0.8165, 13.190, 0.470868, 44.22077), ("S03", 41.3340, 2.2002, 0.9572, 15.473, 0.336716, 39.18941),
    ("S04", 37.3308, 3.2568, 0.8719, 13.895, 0.762728, 33.26942), ("S05", 18.3600, 0.8276, 0.6595, 10.662, 0.049635, 18.04495), ("S06", 24.7979, 1.1098, 0.7107, 11.491, 0.109492, 24.10734),
]
POLICY_B = {"S01": (25.238, 32.807, 6177, 8), "S02": (38.214, 56.241, 3139, 12), "S03": (34.733, 47.935, 3888, 12), "S04": (27.56, 47.101, 1478, 8), "S05": (15.877, 20.843, 12143, 8), "S06": (21.468, 28.127, 7353, 8)}


def mined(spark):
    df = spark.createDataFrame(MINED, "station string, mean double, sd double, utilisation double, mean_cycle_s double, slope_per_h double, intercept double")
    return df.select("station", "mean", "sd"), df.select("station", "utilisation", "mean_cycle_s"), df.select("station", "slope_per_h", "intercept")


def test_policy_matches_the_published_one(spark):
    out = policy.synthesise_policy(adapters.base_policy(spark), *mined(spark)).collect()
    assert {r.station: (r.torque_lcl, r.torque_ucl, r.pm_interval_cycles, r.buffer_capacity) for r in out} == POLICY_B
    assert bottleneck.find_constraint(mined(spark)[1]).first().station == "S03"
    assert degradation.find_fastest_wear(mined(spark)[2]).first().station == "S04"


def test_policy_keeps_what_has_no_input(spark):
    lim, bott, slopes = mined(spark)
    out = {r.station: r for r in policy.synthesise_policy(adapters.base_policy(spark), lim.filter("station <> 'S01'"), bott, slopes.filter("station <> 'S02'")).collect()}
    assert (out["S01"].torque_lcl, out["S01"].pm_interval_cycles) == (23.6, 3000)
    assert (out["S02"].torque_lcl, out["S02"].pm_interval_cycles) == (38.214, 3000)


def test_policy_grid_holds_the_single_policy(spark):
    grid = policy.policy_grid(adapters.base_policy(spark), *mined(spark), [2.0, 3.0], [0.15, 0.2])
    rows = grid.filter("sigma = 3.0 and target_rise = 0.15").collect()
    assert grid.count() == 24 and {r.station: (r.torque_lcl, r.torque_ucl, r.pm_interval_cycles, r.buffer_capacity) for r in rows} == POLICY_B


def test_policy_diff_marks_changes(spark):
    a = adapters.base_policy(spark)
    rows = policy.policy_diff(a, a.withColumn("torque_lcl", F.when(F.col("station") == "S01", 0.0).otherwise(F.col("torque_lcl")))).filter("changed").collect()
    assert [(r.station, r.field, r.A, r.B) for r in rows] == [("S01", "torque_lcl", 23.6, 0.0)]


def test_control_limits_edges(spark):
    nan = float("nan")
    df = spark.createDataFrame([(1, "S01", "torque", 7.0), (1, "S02", "torque", 1.0), (2, "S02", "torque", nan), (3, "S02", "torque", 3.0), (1, "S01", "vibration", 0.5)], TELEMETRY)
    rows = {(r.station, r.signal): r for r in limits.control_limits(df, None, 3.0, {"torque": 0.9}).collect()}
    assert (rows["S01", "torque"].sd, rows["S01", "torque"].lcl) == (0.0, 7.0)
    one = rows["S02", "torque"]
    assert one.n == 3 and one["mean"] != one["mean"] and (one["min"], one["max"]) == (1.0, 3.0)
    assert ("S01", "vibration") in rows


@pytest.mark.parametrize("parts", [1, 3, 50])
def test_moments_merge_far_from_zero(spark, parts):
    rng = random.Random(parts)
    df = spark.createDataFrame([(i, "S01", "torque", 1e8 + rng.random()) for i in range(200)], TELEMETRY).withColumn("part", F.col("ts_ms") % parts)
    merged, whole = limits.moment_merge(limits.moment_partials(df, ["part"])).first(), limits.control_limits(df).first()
    assert merged.n == whole.n and merged.sd == pytest.approx(whole.sd, rel=1e-6) and merged["mean"] == pytest.approx(whole["mean"])


def events(spark, rows):
    return spark.createDataFrame([(t, s, p, c, b, st, d, status, "") for t, s, p, c, b, st, d, status in rows], PART_EVENTS)


def random_events(seed, n=300):
    rng = random.Random(seed)
    return [(rng.randrange(0, 400), rng.choice(["S01", "S02"]), i, rng.randrange(8000, 9000), rng.choice([0, 5, 5, 5]), 0, rng.choice([0] * 9 + [100]), "PASS") for i in range(n)]


@pytest.mark.parametrize("seed", range(3))
def test_runs_and_cycle_state_match_plain_loops(spark, seed):
    rows = random_events(seed)
    df = events(spark, rows)
    expected_run, since, derated = {}, {}, {}
    for station in ("S01", "S02"):
        run = best = count = 0
        last_breach = last_stop = None
        for nth, r in enumerate(sorted((r for r in rows if r[1] == station), key=lambda r: (r[0], r[2])), 1):
            run = run + 1 if r[4] > 0 else 0
            best = max(best, run)
            count = 0 if r[6] > 0 else count + 1
            since[station, r[2]] = count
            derated[station, r[2]] = last_breach is not None and nth - last_breach <= 4 and (last_stop is None or last_stop <= last_breach)
            if r[3] > 8800:
                last_breach = nth
            if r[6] > 0:
                last_stop = nth
        expected_run[station] = best
    for out in (bottleneck.longest_blocked_run(df), bottleneck.longest_blocked_run_chunked(df, 37), bottleneck.longest_blocked_run_chunked(df, 1)):
        assert {r.station: r.longest_blocked_run for r in out.collect()} == expected_run
    assert {(r.station, r.part_id): r.since for r in cycles.cycles_since_maintenance(df, 37).collect()} == since
    for chunk in (1, 37, 10_000):
        held = cycles.spc_derate(df.withColumn("breach", F.col("cycle_ms") > 8800), 4, chunk_ms=chunk)
        assert {(r.station, r.part_id): r.derated for r in held.collect()} == derated
    upper = spark.createDataFrame([("S01", 8800.0), ("S02", 8800.0), ("S09", 1.0)], "station string, ucl double")
    assert {(r.station, r.part_id): r.derated for r in cycles.spc_derate(df, 4, upper, "cycle_ms", 37).collect()} == derated
    assert not any(r.derated for r in cycles.spc_derate(df, 4, upper.filter("station = 'S09'"), "cycle_ms").collect())


def test_oee_guards_and_fallback(spark):
    df = events(spark, [(1000, "S01", 1, 10000, 0, 0, 0, "PASS"), (61000, "S01", 2, 12000, 0, 0, 30000, "FAIL"), (5, "S02", 1, 8000, 0, 0, 0, "PASS"), (6, "S02", 2, 0, 0, 0, 0, "PASS")])
    rows = {r.station: r for r in oee.oee(df, spark.createDataFrame([("S01", 11.0), ("S02", None)], "station string, ideal_cycle_s double")).collect()}
    assert (rows["S01"].availability, rows["S01"].performance, rows["S01"].quality) == (0.5, 1.0, 0.5)
    assert (rows["S02"].parts, rows["S02"].ideal_cycle_s, rows["S02"].ideal_configured) == (1, 8.0, False)
    merged = oee.oee_merge(oee.oee_partials(df)).orderBy("station").collect()
    assert merged == oee.oee(df).orderBy("station").collect()


def test_asof_edges_in_both_forms(spark):
    log = spark.createDataFrame([(10, "S01", "preventive", 5), (100, "S01", "corrective", 10), (-50, "S02", "preventive", 10)], MAINTENANCE)
    samples = spark.createDataFrame([(14, "S01", "torque", 1.0), (15, "S01", "torque", 2.0), (109, "S01", "torque", 3.0), (110, "S01", "torque", 4.0), (90_000_000, "S01", "torque", 5.0), (5, "S02", "torque", 6.0)], TELEMETRY)
    for few in (100, 0):
        found = asof.asof_maintenance(samples, log, keep_unmatched=True, broadcast_rows=few)
        assert {r.value: r.fresh for r in found.collect()} == {1.0: None, 2.0: 15, 3.0: 15, 4.0: 110, 5.0: 110, 6.0: None}
        assert asof.asof_maintenance(samples, log, broadcast_rows=few).count() == 4


def test_overlapping_stops_do_not_repeat_samples(spark):
    log = spark.createDataFrame([(10, "S01", "preventive", 20), (15, "S01", "corrective", 30), (100, "S01", "corrective", 0)], MAINTENANCE)
    samples = spark.createDataFrame([(t, "S01", "torque", float(t)) for t in (9, 10, 20, 44, 45, 100)], TELEMETRY)
    for few in (100, 0):
        assert {r.ts_ms: r.stopped for r in asof.label_stopped(samples, log, few).collect()} == {9: False, 10: True, 20: True, 44: True, 45: False, 100: False}


@pytest.mark.parametrize("seed", range(3))
def test_both_forms_of_joins_match_plain_loops(spark, seed):
    """With null stations and times on either side, ties, overlapping stops, and columns named as the results and helpers are."""
    rng = random.Random(seed)
    log = [(rng.choice([None, *range(-100, 3000)]), rng.choice(["S01", "S02", "S03", None]), "preventive", rng.randrange(0, 400)) for _ in range(40)]
    log += [(500_000_000 + i, "S01", "corrective", 7) for i in range(30)]
    samples = [(rng.choice([None, *range(-100, 4000), 500_000_010, 900_000_000]), rng.choice(["S01", "S02", "S04", None]), "torque", float(i)) for i in range(300)]
    named = spark.createDataFrame(samples, TELEMETRY).withColumns({c: F.lit("own") for c in ("fresh", "until", "on_station", "begin", "end", "stopped", "at", "mark", "cell", "row", "next_end")})
    maintenance = spark.createDataFrame(log, MAINTENANCE)
    fresh, stopped = {}, {}
    for t, station, _, value in samples:
        known = t is not None and station is not None
        ends = [a + d for a, s, _, d in log if known and s == station and a is not None and 0 <= a + d <= t]
        fresh[value] = max(ends, default=None)
        stopped[value] = known and any(s == station and a is not None and a <= t < a + d for a, s, _, d in log)
    for few in (100, 0):
        found = asof.asof_maintenance(named, maintenance, keep_unmatched=True, broadcast_rows=few).collect()
        assert len(found) == len(samples) and {r.value: r.fresh for r in found} == fresh and {r.until + r.on_station + r.row for r in found} == {"ownownown"}
        found = asof.asof_maintenance(named, maintenance, broadcast_rows=few).collect()
        assert {r.value: r.fresh for r in found} == {v: f for v, f in fresh.items() if f is not None}
        found = asof.label_stopped(named, maintenance, few).collect()
        assert len(found) == len(samples) and {r.value: r.stopped for r in found} == stopped and {r.begin + r.end for r in found} == {"ownown"}
    ends = spark.createDataFrame([(t, s) for t, s, _, _ in samples[:100]], "ts_end_ms long, station string")
    ours = {r.value: r.cycle_end_ms for r in asof.attach_cycle(named, ends).collect()}
    at = {s: sorted(t for t, x, _, _ in samples[:100] if x == s and t is not None) for s in ("S01", "S02", "S04")}
    assert all(ours[v] == next((e for e in at[s] if e >= t), at[s][-1]) for t, s, _, v in samples if t is not None and s is not None)


@pytest.mark.parametrize("chunk", [1, 50, 100_000])
def test_merged_stops_in_chunks(spark, chunk):
    rng = random.Random(chunk)
    log = [(rng.randrange(0, 2000), rng.choice(["S01", "S02"]), "preventive", rng.choice([0, 5, 30, 600])) for _ in range(60)]
    out = {(r.station, r.begin, r.end) for r in asof.merged_stops(spark.createDataFrame(log, MAINTENANCE), chunk).collect()}
    expected = set()
    for station in ("S01", "S02"):
        open_ = None
        for t, d in sorted((t, d) for t, s, _, d in log if s == station and d):
            if open_ and t <= open_[1]:
                open_[1] = max(open_[1], t + d)
            else:
                expected |= {(station, *open_)} if open_ else set()
                open_ = [t, t + d]
        expected |= {(station, *open_)} if open_ else set()
    assert out == expected


def test_policy_without_inputs_is_refused(spark):
    lim, bott, slopes = mined(spark)
    for inputs in ((lim.limit(0), bott, slopes), (lim, bott.limit(0), slopes)):
        with pytest.raises(Exception, match="no control limits|no utilisation"):
            policy.synthesise_policy(adapters.base_policy(spark), *inputs).collect()
    lines = adapters.base_policy(spark).crossJoin(spark.createDataFrame([("l1",), ("l2",)], "line string"))
    own = [df.crossJoin(spark.createDataFrame([("l1",), ("l2",)], "line string")) for df in (lim, bott, slopes)]
    out = policy.synthesise_policy(lines, *own, line=["line"]).collect()
    assert len(out) == 12 and {r.station: (r.torque_lcl, r.torque_ucl, r.pm_interval_cycles, r.buffer_capacity) for r in out if r.line == "l2"} == POLICY_B
    with pytest.raises(Exception, match="no control limits"):
        policy.synthesise_policy(lines, own[0].filter("line = 'l1'"), *own[1:], line=["line"]).collect()


def test_constraint_is_ranked_as_reported(spark):
    table = spark.createDataFrame([("S02", 0.95671), ("S01", 0.95669)], "station string, utilisation double")
    assert bottleneck.find_constraint(table).first().station == "S01"


def test_ordered_results(spark):
    log = spark.createDataFrame([(5, "S02", "preventive", 1), (5, "S01", "preventive", 2), (1, "S09", "corrective", 3), (5, "S01", "corrective", 9)], MAINTENANCE)
    assert [tuple(r) for r in lines.ordered_log(log).collect()] == [(1, "S09", "corrective", 3), (5, "S01", "corrective", 9), (5, "S01", "preventive", 2), (5, "S02", "preventive", 1)]
    curve = spark.createDataFrame([("S02", 0.0), ("S01", 2.0), ("S01", 0.5)], "station string, age_h double")
    assert [tuple(r) for r in degradation.ordered_curve(curve).collect()] == [("S01", 0.5), ("S01", 2.0), ("S02", 0.0)]


def test_forward_asof_clips_to_the_last_cycle(spark):
    ends = spark.createDataFrame([(100, "S01"), (40_000_000, "S01")], "ts_end_ms long, station string")
    samples = spark.createDataFrame([(100, "S01", "torque", 1.0), (101, "S01", "torque", 2.0), (50_000_000, "S01", "torque", 3.0)], TELEMETRY)
    assert {r.value: r.cycle_end_ms for r in asof.attach_cycle(samples, ends).collect()} == {1.0: 100, 2.0: 40_000_000, 3.0: 40_000_000}


def test_leaving_stopped_samples_in_flattens_the_slope(spark):
    rows = [(h * 1_800_000 + i, "S01", "torque", 0.5 if i < h else 30.0 + h) for h in range(6) for i in range(20)]
    aged = spark.createDataFrame(rows, TELEMETRY).withColumn("fresh", F.lit(0).cast("long"))
    row = limits.filter_bias(aged, 5.0).first()
    assert row.slope_running == pytest.approx(2.0) and row.slope_all < row.slope_running and row.sd_all > row.sd_running


def test_slopes_need_three_buckets(spark):
    curve = spark.createDataFrame([("S01", 0.0, 10, 1.0), ("S01", 1.0, 10, 2.0), ("S02", 0.0, 10, 1.0), ("S02", 1.0, 10, 3.0), ("S02", 2.0, 10, 5.0), ("S02", 9.0, 1, 0.0)], "station string, age_h double, n long, mean double")
    assert [(r.station, r.slope_per_h, r.intercept, r.buckets) for r in degradation.degradation_slopes(curve).collect()] == [("S02", pytest.approx(2.0), pytest.approx(1.0), 3)]


def test_shift_day_is_clamped(spark):
    df = spark.createDataFrame([(0,), (28_800_000,), (28_799_999,), (999_999_999_999,)], "ts_ms long")
    assert [str(r.dt) for r in filters.assign_shift_day(df, "2024-01-01", 7).collect()] == ["2024-01-01", "2024-01-02", "2024-01-01", "2024-01-07"]


def test_paired_ci_and_verdicts(spark):
    runs = lambda good, down, value: spark.createDataFrame([(s, good + s, down + s % 2, value) for s in range(4)], "seed long, throughput_good_parts long, total_downtime_h double, line_oee double")
    ci = ab.paired_ci(ab.pair_runs(runs(100, 5.0, 0.9), runs(110, 6.0, 0.9)))
    rows = {r.metric: r for r in ab.ab_table(ci).collect()}
    assert (rows["throughput_good_parts"].verdict, rows["total_downtime_h"].verdict, rows["line_oee"].verdict) == ("B better", "B WORSE", "no effect")
    both = runs(100, 5.0, 0.9).withColumn("arm", F.lit("A")).unionByName(runs(110, 6.0, 0.9).filter("seed < 3").withColumn("arm", F.lit("B")))
    pairs = ab.pair_runs(runs(100, 5.0, 0.9), runs(110, 6.0, 0.9).filter("seed < 3"))
    assert sorted(map(tuple, ab.pair_arms(both).collect())) == sorted(map(tuple, pairs.collect()))
    one = ab.paired_ci(ab.pair_runs(runs(1, 1.0, 1.0).limit(1), runs(2, 1.0, 1.0).limit(1)))
    assert all(r.delta_ci95 == 0.0 for r in one.collect())


def test_line_figures(spark):
    df = events(spark, [(1, "S01", 1, 10000, 0, 50, 0, "PASS"), (2, "S02", 1, 10000, 0, 10, 3_600_000, "PASS"), (3, "S02", 2, 10000, 0, 10, 0, "FAIL")]).withColumn("run", F.lit("A-1"))
    ideal = spark.createDataFrame([("S01", 9.0), ("S02", 10.0)], "station string, ideal_cycle_s double")
    table = kpis.station_kpis(df, None, ideal, kpis.horizon(1))
    row = kpis.line_kpis(table, 1).first()
    assert (row.throughput_good_parts, row.total_downtime_h, row.bottleneck_by_ground_truth) == (1, 1.0, "S02")
    checked = report.validate_kpis(table.select("station", "quality"), table.select("station", (F.col("quality") + 0.01).alias("quality")), ["quality"])
    assert [r.matches for r in checked.collect()] == [False, False]


def test_output_diff_is_by_multiset(spark):
    a, b = (spark.createDataFrame([(v,) for v in x], "v int") for x in ([1, 1, 2], [1, 2, 3]))
    assert sorted((r.v, r.side) for r in report.diff_outputs(a, b).collect()) == [(1, "A"), (3, "B")]
    assert report.diff_outputs(a, a).count() == 0
    c, d = (spark.createDataFrame([(v, "x") for v in x], "n int, side_ string") for x in ([1, 1, None], [None, None]))
    assert sorted((str(r.n), r.side) for r in report.diff_outputs(c, d).collect()) == [("1", "A"), ("1", "A"), ("None", "B")]


def test_operators_accept_empty_tables(spark):
    t, e, m = (spark.createDataFrame([], s) for s in (TELEMETRY, PART_EVENTS, MAINTENANCE))
    outs = [limits.control_limits(t), oee.oee(e), bottleneck.bottleneck(e), degradation.degradation(t, m), asof.label_stopped(t, m), asof.attach_cycle(t, e), cycles.cycles_since_maintenance(e), asof.asof_maintenance(t, m, broadcast_rows=0)]
    assert [o.count() for o in outs] == [0] * len(outs)
