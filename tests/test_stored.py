"""Stored roll-ups, chunks and days: what is read, what is replaced, and equality with one pass; state of the streams."""

import glob
import os

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from linespark.functions import moments
from linespark.operators import ab, asof, bottleneck, cycles, degradation, filters, limits, oee, policy, report
from linespark.plans import adapters, stored
from linespark.schemas import PART_EVENTS
from linespark.sources import rollups, sinks
from linespark.streaming import live

SF = "/root/testdata/sf0.001"


def rows_of(df, digits=6):
    names = sorted(df.columns)
    return sorted(tuple(str(round(v, digits) + 0.0) if isinstance(v, float) else str(v) for v in r) for r in df.select(names).collect())


def plan_of(df):
    return df._jdf.queryExecution().toString()


def test_burst_of_stops_beside_an_outlier(spark):
    """Cells hold equal numbers of stops, whatever the times."""
    log = spark.range(6000).select((F.lit(1_700_000_000_000) + F.col("id") * 150).alias("ts_ms"), F.concat(F.lit("S0"), F.col("id") % 3).alias("station"), F.lit("preventive").alias("event"), (F.col("id") % 7 * 40).alias("duration_ms"))
    log = log.unionByName(spark.createDataFrame([(0, f"S0{i}", "preventive", 5) for i in range(3)], log.schema))
    samples = spark.range(3000).select((F.lit(1_699_999_950_000) + F.col("id") * 331).alias("ts_ms"), F.concat(F.lit("S0"), F.col("id") % 4).alias("station"), F.col("id").alias("value"))
    samples = samples.unionByName(spark.createDataFrame([(None, "S01", -1), (5, None, -2), (3, "S01", -3), (5, "S01", -4), (-9, "S02", -5)], "ts_ms long, station string, value long"))
    spans = asof.maintenance_intervals(log).filter("until is null or until > fresh").selectExpr("station", "fresh begin", "until end")
    met = asof._met(samples, spans).filter("_span is not null").groupBy("_span.station", "_span.cell").agg(F.count_distinct("_span.begin").alias("n"))
    assert met.agg(F.max("n")).first()[0] <= 2
    for operator in (asof.asof_maintenance, asof.label_stopped):
        assert rows_of(operator(samples, log)) == rows_of(operator(samples, log, broadcast_rows=0))
    assert "BroadcastHashJoin" in plan_of(asof.asof_maintenance(samples, log))


def test_replacing_a_day_reads_partials_only(spark, tmp_path):
    rows = stored._by_day(adapters.telemetry(spark, SF))
    path = str(tmp_path / "days")
    rollups.store_parts(limits.moment_partials(rows, ["dt"]), path)
    files = {f: os.path.getmtime(f) for f in glob.glob(f"{path}/dt=*/*.parquet")}
    day = rows.filter("dt = '2024-01-15'").withColumn("value", F.col("value") + 1)
    for _ in range(2):
        rollups.store_parts(limits.moment_partials(day, ["dt"]), path)
    after = {f: os.path.getmtime(f) for f in glob.glob(f"{path}/dt=*/*.parquet")}
    assert {f for f in files if f not in after} == {f for f in files if "dt=2024-01-15" in f}
    assert all(after[f] == t for f, t in files.items() if f in after)
    merged = limits.moment_merge(rollups.read_parts(spark, path))
    assert all(f"file:{path}" in f or path in f for f in merged.inputFiles()) and "events.parquet" not in plan_of(merged)
    assert rows_of(merged) == rows_of(limits.control_limits(rows.filter("dt <> '2024-01-15'").unionByName(day)))


def test_comoments_of_any_split(spark):
    curve = degradation.degradation(adapters.telemetry(spark, SF), adapters.maintenance(spark, SF), "torque", 1800, 5.0)
    fitted = filters.fitted_buckets(curve)
    for parts in (1, 3, 1000):
        got = degradation.slope_merge(degradation.slope_partials(fitted, [F.pmod(F.xxhash64("age_h"), F.lit(parts)).alias("part")]))
        assert rows_of(got) == rows_of(degradation.degradation_slopes(curve))
    far = spark.createDataFrame([("a", i % 2, 1e8 + i, 3.0 * i) for i in range(4)], "station string, part int, x double, y double")
    one = moments.merge_comoments(far.groupBy("station", "part").agg(*moments.comoments(F.col("x"), F.col("y"))), ["station"]).first()
    assert (one["n"], round(one["cxx"], 9), round(one["cxy"], 9)) == (4, 5.0, 15.0)
    short = spark.createDataFrame([("a", 1.0, 2.0), ("a", 1.0, 3.0), ("a", 1.0, 4.0), ("b", 1.0, 2.0)], "station string, age_h double, mean double")
    assert degradation.slope_merge(degradation.slope_partials(short, [F.lit(0).alias("part")])).count() == 0


def test_chunks_are_extended_without_old_rows(spark, tmp_path):
    events = stored._breaches(adapters.part_events(spark, SF))
    chunk, cut = stored.CHUNK_MS, stored.NEW_CHUNK * stored.CHUNK_MS
    for name, rows in (("old", events.filter(F.col("ts_end_ms") < cut)), ("new", events.filter(F.col("ts_end_ms") >= cut))):
        rows.write.parquet(str(tmp_path / name))
    old, new = (spark.read.parquet(str(tmp_path / n)) for n in ("old", "new"))
    path = str(tmp_path / "chunks")
    rollups.store_parts(cycles.state_chunks(old, chunk), path, "chunk")
    earlier = rollups.read_parts(spark, path)
    for got, whole in ((cycles.cycles_since_maintenance(new, chunk, earlier), cycles.cycles_since_maintenance(events, chunk)), (cycles.spc_derate(new, 40, chunk_ms=chunk, earlier=earlier), cycles.spc_derate(events, 40, chunk_ms=chunk))):
        assert rows_of(got) == rows_of(whole.filter(F.col("ts_end_ms") >= cut))
        assert not any("/old/" in f for f in got.inputFiles())
    runs = str(tmp_path / "runs")
    for rows in (old, new, new):
        rollups.store_parts(bottleneck.run_chunks(rows, chunk), runs, "chunk")
    stitched = bottleneck.bottleneck_of_chunks(rollups.read_parts(spark, runs))
    assert rows_of(stitched) == rows_of(bottleneck.bottleneck(events)) and all("/runs/" in f for f in stitched.inputFiles())


def test_fingerprints_find_what_differs(spark):
    rows = [(i % 50, None if i % 7 == 0 else "x", float(i % 3)) for i in range(300)] + [(None, "y", 0.0), (1, None, float("nan"))]
    a = spark.createDataFrame(rows, "bucket long, s string, v double")
    b = a.repartition(5)
    assert report.differing_buckets(report.fingerprints(a), report.fingerprints(b)).count() == 0
    assert report.diff_by_fingerprints(a, b).count() == 0
    c = spark.createDataFrame([*rows[5:], rows[9], (None, None, -0.0), (0, "null moved", 1.0)], a.schema)
    assert rows_of(report.diff_by_fingerprints(a, c, 16)) == rows_of(report.diff_outputs(a, c))
    halves = report.fingerprints(a.filter("bucket < 20")).unionByName(report.fingerprints(a.filter("not coalesce(bucket < 20, false)")))
    assert rows_of(report.merge_fingerprints(halves)) == rows_of(report.fingerprints(a))
    # A value that moves to another column is seen.
    p, q = (spark.createDataFrame([r], "x long, y long") for r in ((1, None), (None, 1)))
    assert report.differing_buckets(report.fingerprints(p), report.fingerprints(q)).count() > 0
    assert report.diff_by_fingerprints(a.limit(0), a.limit(0)).count() == 0


def test_days_of_a_run_are_replaced(spark, tmp_path):
    path = str(tmp_path / "runs")
    rows = stored._by_day(adapters.telemetry(spark, SF))
    for run in "ab":
        sinks.ingest_run(rows, run, path)
    before = {f: os.path.getmtime(f) for f in glob.glob(f"{path}/*/*/*/*.parquet")}
    new = rows.filter("dt in ('2024-01-02', '2024-01-03') and station <> 'S01'").withColumn("value", F.lit(1.0))
    sinks.ingest_days(new, "a", path)
    after = {f: os.path.getmtime(f) for f in glob.glob(f"{path}/*/*/*/*.parquet")}
    gone = {f for f in before if f not in after}
    assert gone == {f for f in before if "run=a" in f and ("dt=2024-01-02" in f or "dt=2024-01-03" in f)}
    assert all(after[f] == t for f, t in before.items() if f in after)
    read = spark.read.parquet(path).filter("run = 'a' and dt between '2024-01-02' and '2024-01-03'")
    assert rows_of(read.select("ts_ms", "station", "value")) == rows_of(new.select("ts_ms", "station", "value"))
    with pytest.raises(ValueError, match="dt and station"):
        sinks.ingest_days(rows.drop("dt"), "a", path)


def test_scoring_reads_scored_days_only(spark, tmp_path):
    path = str(tmp_path / "scored")
    rows = stored._by_day(adapters.telemetry(spark, SF))
    for run in "abc":
        sinks.ingest_run(rows, run, path)
    starts = spark.createDataFrame([("a", "2024-01-20"), ("b", "2024-01-28")], "run string, first string").selectExpr("run", "cast(first as date) first_dt")
    scored = filters.score_stored_days(spark.read.parquet(path), starts)
    assert rows_of(scored.select("run", "ts_ms", "station")) == rows_of(rows.filter("dt >= '2024-01-20'").selectExpr("'a' run", "ts_ms", "station").unionByName(rows.filter("dt >= '2024-01-28'").selectExpr("'b' run", "ts_ms", "station")))
    scored.collect()
    plan = plan_of(scored)
    assert "PartitionFilters: [" in plan and "dt#" in plan.split("PartitionFilters: [")[1].split("]")[0]
    assert "dynamicpruning" in plan
    known = spark.read.parquet(path).filter("dt >= '2024-01-20'")
    files = [f for f in glob.glob(f"{path}/*/*/*/*.parquet") if f.split("dt=")[1][:10] >= "2024-01-20"]
    scan = known._jdf.queryExecution().executedPlan().collectLeaves().head()
    known.collect()
    assert scan.metrics().apply("numFiles").value() in (0, len(files))


def test_oee_needs_its_partials_only(spark, tmp_path):
    events = stored._by_month(adapters.part_events(spark, SF))
    rollups.store_parts(oee.oee_partials(events), str(tmp_path / "oee"))
    merged = oee.oee_merge(rollups.read_parts(spark, str(tmp_path / "oee")))
    assert rows_of(merged) == rows_of(oee.oee(events)) and all("/oee/" in f for f in merged.inputFiles())


def test_repeated_runs_of_an_arm_are_refused(spark):
    runs = spark.createDataFrame([("A", 1, 5.0, 1.0, 0.5), ("A", 1, 6.0, 1.0, 0.5), ("B", 1, 7.0, 1.0, 0.5)], "arm string, seed long, throughput_good_parts double, total_downtime_h double, line_oee double")
    with pytest.raises(Exception, match="arm A has several runs of seed 1"):
        ab.pair_arms(runs).collect()


def test_hold_takes_cycles_in_their_order_and_forgets_free_stations(spark, tmp_path):
    fields = f"{PART_EVENTS}, breach boolean"
    hour = 3_600_000
    cycle = lambda t, station="S01", stop=0, breach=False: (t * hour, station, t, 100, 0, 0, stop, "PASS", "", breach)
    arrivals = [
        [cycle(3, breach=True), cycle(1), cycle(2), cycle(2, "S02", breach=True)],
        # Late by more than the delay: dropped. The rest is out of order.
        [cycle(6, stop=5), cycle(5), cycle(4), cycle(1, "S02", breach=True), cycle(7)],
        [cycle(8, breach=True), cycle(9, stop=5, breach=True), cycle(10), cycle(8, "S02"), cycle(9, "S02")],
        [cycle(100, "")],
    ]
    source, out, checkpoint = (str(tmp_path / n) for n in ("in", "out", "checkpoint"))
    for rows in arrivals:
        spark.createDataFrame(rows, fields).coalesce(1).write.mode("append").parquet(source)
        live.run_available(live.derate_stream(spark.readStream.schema(fields).parquet(source), 2), out, checkpoint)
    got = spark.read.schema(f"{fields}, derated boolean").parquet(out)
    events = spark.createDataFrame([r for a in arrivals[:3] for r in a if not (r[1] == "S02" and r[0] == hour)], fields)
    assert rows_of(got) == rows_of(cycles.spc_derate(events, 2).drop("nth"))
    spark.conf.set(live.PROVIDER, live.ROCKS_DB)
    try:
        left = spark.read.format("statestore").option("stateVarName", "left").load(checkpoint).selectExpr("key.station station", "value.left left").collect()
    finally:
        spark.conf.unset(live.PROVIDER)
    assert [tuple(r) for r in left] == [("S01", 1)]


def test_hold_keeps_waiting_cycles_in_few_pieces(spark, tmp_path, monkeypatch):
    """Of 20 000 cycles out of order, over two arrivals whose times overlap: a state row for each cycle made it slow."""
    fields, rng = f"{PART_EVENTS}, breach boolean", np.random.default_rng(3)
    rows = [(int(t) * 60_000, f"S0{rng.integers(3)}", i, int(rng.integers(90, 110)), None if i % 5 else 0, 0, 5 * int(rng.integers(0, 40) == 0), "PASS", None, bool(rng.integers(0, 30) == 0)) for i, t in enumerate(rng.integers(0, 3000, 20_000))]
    arrived = np.array([r[0] for r in rows]) + rng.integers(0, 500 * 60_000, len(rows)) >= 1500 * 60_000
    source, out, checkpoint = (str(tmp_path / n) for n in ("in", "out", "checkpoint"))
    monkeypatch.setattr(live, "RUN_ROWS", 3000)
    kept = []
    for part in (*([r for r, a in zip(rows, arrived, strict=True) if a == late] for late in (False, True)), [(10**12, "", 0, 0, 0, 0, 0, "", "", False)]):
        spark.createDataFrame(part, fields).coalesce(2).write.mode("append").parquet(source)
        live.run_available(live.derate_stream(spark.readStream.schema(fields).parquet(source), 7, "600 minutes"), out, checkpoint)
        spark.conf.set(live.PROVIDER, live.ROCKS_DB)
        try:
            kept.append(spark.read.format("statestore").option("stateVarName", "waiting").load(checkpoint).count())
        finally:
            spark.conf.unset(live.PROVIDER)
    got = spark.read.schema(f"{fields}, derated boolean").parquet(out)
    assert rows_of(got) == rows_of(cycles.spc_derate(spark.createDataFrame(rows, fields), 7).drop("nth"))
    assert 0 < kept[0] < 100 and kept[-1] <= 1, kept


@pytest.mark.parametrize("piece_rows", [3, 1000])
def test_pieces_of_the_hold_are_merged_in_order(monkeypatch, piece_rows):
    """Also where pieces overlap and ties lie across their borders; what is later than the watermark waits on."""
    monkeypatch.setattr(live, "PIECE_ROWS", piece_rows)
    rng = np.random.default_rng(4)
    n = 900
    columns = {"ts_end_ms": rng.integers(0, 60, n), "station": np.full(n, "S01"), "part_id": rng.permutation(n), **{c: rng.integers(0, 2, n) for c in ("cycle_ms", "blocked_ms", "starved_ms", "down_ms")}, "status": np.full(n, "PASS")}
    table = pa.table(columns)
    hold, state = live.Hold(5), {}
    for nth, piece in enumerate(live._pieces(table.to_batches(max_chunksize=50), table.column_names, 50, piece_rows)):
        for k in range(piece.num_rows):
            _, first, last, data = (piece.column(i)[k].as_py() for i in range(4))
            state[(first, last, 1000 * nth + k)] = (data,)
    hold.waiting = type("Waiting", (), {"getValue": state.get, "removeKey": state.pop, "updateValue": state.__setitem__})
    found = [live._table_of(live._bytes_of(t)) for passed in (-1, 20, 40, 60) for t in hold._ready(sorted(k for k in state if k[0] <= passed), passed)]
    assert not state and (len(found) > 10) == (piece_rows == 3)
    assert pa.concat_tables(found).to_pylist() == sorted(table.to_pylist(), key=lambda r: [r[c] for c in live.ORDER])


def test_hold_over_arrays_is_that_of_single_cycles():
    rng = np.random.default_rng(5)
    for hold in (0, 1, 4):
        breach, stop = rng.random((2, 3000)) < 0.1
        one, left = [], 2
        for b, s in zip(breach, stop, strict=True):
            one.append(left > 0)
            left = hold if b else 0 if s else max(0, left - 1)
        parts, carried = [], 2
        for at in range(0, 3000, 3):
            derated, carried = live._held(breach[at : at + 3], stop[at : at + 3], carried, hold)
            parts.append(derated)
        assert np.concatenate(parts).tolist() == one and carried == left


def test_one_pass_gives_what_two_give(spark):
    events = adapters.part_events(spark, SF)
    odd = spark.createDataFrame([(5, "S09", 1, 0, 10, 20, 0, "PASS", ""), (6, "S09", 2, 0, 0, 0, 5, "FAIL", "x"), (7, "S10", 3, 0, 7, 0, 0, "PASS", ""), (9, "S10", 4, 900, 0, 0, 0, "PASS", "")], PART_EVENTS)
    events = events.select(*odd.columns).unionByName(odd)
    ideal = adapters.ideal_cycles(spark, "S02")
    both = bottleneck.oee_and_bottleneck(events, ideal)
    assert rows_of(both.filter("oee is not null").select("station", "oee.*")) == rows_of(oee.oee(events, ideal))
    assert rows_of(both.select("station", "bottleneck.*")) == rows_of(bottleneck.bottleneck(events))
    assert both.filter("oee is null").count() == 1
    samples, log = adapters.telemetry(spark, SF), adapters.maintenance(spark, SF)
    early = spark.createDataFrame([(5, "S01", "torque", 50.0), (6, "S09", "torque", 7.0), (7, "S09", "torque", 9.0)], samples.schema)
    samples = samples.unionByName(early)
    one = degradation.limits_and_slopes(samples, log, "torque", 1800, 5.0)
    limits_of = limits.control_limits(samples, ["torque"], 3.0, {"torque": 5.0})
    slopes = degradation.degradation_slopes(degradation.degradation(samples, log, "torque", 1800, 5.0))
    assert rows_of(one.select("station", "n", "mean", "sd")) == rows_of(limits_of.select("station", "n", "mean", "sd"))
    assert rows_of(one.filter("buckets is not null").select(*slopes.columns)) == rows_of(slopes)
    assert one.filter("station = 'S09'").first()["slope_per_h"] is None
    stations = adapters.base_policy(spark)
    assert rows_of(policy.station_table_of(stations, both, one)) == rows_of(policy.station_table(stations, oee.oee(events, ideal), bottleneck.bottleneck(events), limits_of, slopes))
    assert rows_of(policy.synthesise_policy(stations, one, bottleneck.bottleneck(events))) == rows_of(policy.synthesise_policy(stations, limits_of, bottleneck.bottleneck(events), slopes))
    # The samples once, and the log for its borders and its spans, which share one sort.
    one.collect()
    final = plan_of(one).split("== Physical Plan ==")[1].split("== Initial Plan ==")[0]
    assert final.count("FileScan parquet") <= 3 and "ReusedExchange" in final
