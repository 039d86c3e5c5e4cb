"""CSV, policy and text sources and sinks with hand-made files."""

import json

import pytest
from pyspark.sql import functions as F

from linespark.operators import quality
from linespark.plans import adapters
from linespark.sources import lines, policies, sinks

TELEMETRY = """ts_ms,station,signal,value
10,S01,torque,28.5
 20 , S01 , torque , 1.0

30,S01,vibration,oops
40,S01,torque,oops
x,S01,torque,9.0
12.5,S01,torque,9.0
50,,torque,9.0
60,S01
70,S01,torque,NaN
ts_ms,station,signal,value
"""

EVENTS = """ts_end_ms,station,part_id,cycle_ms,blocked_ms,starved_ms,down_ms,status,defect_code
100,S01,1,9000,0,0,0,PASS,
200,S01,2,0,5,0,0,FAIL,misalign
300,S01,3,9000,5,0,0,PASS
400,,4,9000,5,0,0,PASS,
500,S01,5,9000,zz,0,0,PASS,
600,S01,6
"""


@pytest.fixture()
def tree(tmp_path):
    for station in ("S01",):
        at = tmp_path / "telemetry" / "dt=2024-01-01" / f"station={station}"
        at.mkdir(parents=True)
        (at / "part-0.csv").write_text(TELEMETRY)
    at = tmp_path / "part_events" / "dt=2024-01-01"
    at.mkdir(parents=True)
    (at / "part-0.csv").write_text(EVENTS)
    (tmp_path / "maintenance.csv").write_text("ts_ms,station,event,duration_ms\n\n5,S01,preventive,10\n7,S01\n")
    return tmp_path


def classes(df):
    return {r["class"]: r["n"] for r in quality.quality_report(df).collect()}


def test_columns_do_not_shift_with_station_folders(spark, tree):
    rows = lines.read_telemetry(spark, str(tree / "telemetry")).orderBy("ts_ms").collect()
    assert [(r.ts_ms, r.station, r.signal) for r in rows] == [(10, "S01", "torque"), (20, "S01", "torque"), (70, "S01", "torque")]
    assert str(rows[0].dt) == "2024-01-01"


def test_part_events_allow_a_missing_defect_code(spark, tree):
    rows = lines.read_part_events(spark, str(tree / "part_events")).orderBy("ts_end_ms").collect()
    assert [(r.ts_end_ms, r.defect_code) for r in rows] == [(100, ""), (200, "misalign"), (300, "")]


def test_maintenance_skips_short_lines(spark, tree):
    assert [tuple(r) for r in lines.read_maintenance(spark, str(tree / "maintenance.csv")).collect()] == [(5, "S01", "preventive", 10)]


def test_row_classes_differ_by_job(spark, tree):
    telemetry, events = (lines.read_lines(spark, str(tree / n)) for n in ("telemetry", "part_events"))
    log = lines.read_maintenance(spark, str(tree / "maintenance.csv"))
    assert classes(quality.classify_oee(events)) == {"HEADER": 1, "PARSED": 2, "MALFORMED": 4}
    assert classes(quality.classify_bottleneck(events)) == {"PARSED": 3, "MALFORMED": 3}
    assert classes(quality.classify_limits(telemetry, "torque", 5.0)) == {"HEADER": 2, "KEPT": 4, "FILTERED_NOT_RUNNING": 1, "FILTERED_OTHER_SIGNAL": 1, "MALFORMED": 3}
    assert classes(quality.classify_degradation(telemetry, log, "torque", 5.0)) == {"FILTERED_OTHER_SIGNAL": 1, "FILTERED_NOT_RUNNING": 1, "MALFORMED": 4, "NO_MAINTENANCE_YET": 2, "JOINED": 1}


def test_gate_counts(spark, tmp_path):
    (tmp_path / "seed.csv").write_text("timestamp,station_id,signal,value\n" + "1,S01,torque,1\n" * 200 + "1,,torque,1\n")
    rows = {r.station: (r.records, r.malformed) for r in quality.count_per_station(lines.read_lines(spark, str(tmp_path / "seed.csv"))).collect()}
    assert rows == {"S01": (200, 0), None: (0, 1)}


def test_kv_text_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("S01", "torque", 5, 1.23456, 0.5, -1.0, 3.0, 0.0, 2.0)], "station string, signal string, n long, mean double, sd double, lcl double, ucl double, min double, max double")
    sinks.to_kv_text(df, "limits").write.text(str(tmp_path / "kv"))
    row = lines.read_kv_rows(spark, str(tmp_path / "kv")).first()
    assert row.key == "S01" and row["values"]["mean"] == "1.2346" and row["values"]["n"] == "5"


def test_kv_rows_keep_bare_parts_and_first_equals_sign(spark):
    df = spark.createDataFrame([("S01\ta=1=2\tbare\ta=3\t",), ("  ",)], "value string")
    row = lines.parse_kv_rows(df).collect()
    assert len(row) == 1 and row[0]["values"] == {"a": "3"} and row[0].extra == ["bare", ""]


def test_policy_round_trip_and_missing_station(spark, tmp_path):
    base = adapters.base_policy(spark).withColumns({"policy_id": F.lit("A"), "provenance": F.lit("base")})
    policies.write_policy(base, str(tmp_path / "policy"))
    back = policies.read_policy(spark, str(tmp_path / "policy"))
    assert sorted(map(tuple, back.select(base.columns).collect())) == sorted(map(tuple, base.collect()))
    document = json.loads(next((tmp_path / "policy").glob("part-*.txt")).read_text())
    assert list(document["stations"]) == ["S01", "S02", "S03", "S04", "S05", "S06"]
    with pytest.raises(ValueError, match="S09"):
        policies.read_policy(spark, str(tmp_path / "policy"), spark.createDataFrame([("S09",)], "station string"))


def test_ingest_replaces_only_its_own_run(spark, tmp_path):
    df = spark.createDataFrame([("2024-01-01", "S01", 1), ("2024-01-02", "S01", 2)], "dt string, station string, v int")
    path = str(tmp_path / "store")
    sinks.ingest_run(df, "a", path)
    sinks.ingest_run(df, "b", path)
    sinks.ingest_run(df.withColumn("v", F.col("v") + 10), "a", path)
    rows = sorted((r.run, str(r.dt), r.v) for r in spark.read.parquet(path).collect())
    assert rows == [("a", "2024-01-01", 11), ("a", "2024-01-02", 12), ("b", "2024-01-01", 1), ("b", "2024-01-02", 2)]


def test_ingest_leaves_nothing_of_the_old_run(spark, tmp_path):
    df = spark.createDataFrame([("2024-01-01", "S01", 1), ("2024-01-02", "S02", 2)], "dt string, station string, v int")
    for rows in (df, df.filter("v = 1")):
        sinks.ingest_run(rows, "a", str(tmp_path / "store"))
    assert [r.v for r in spark.read.parquet(str(tmp_path / "store")).collect()] == [1]
    with pytest.raises(ValueError, match="dt and station"):
        sinks.ingest_run(df.select("v"), "a", str(tmp_path / "other"))
    with pytest.raises(ValueError, match="name of a run"):
        sinks.ingest_run(df, "../a", str(tmp_path / "other"))


def test_a_cluster_needs_a_shared_folder(spark):
    from types import SimpleNamespace

    from linespark.sources import shared

    conf = SimpleNamespace(get=lambda key, default: None)

    def on(master, path=None):
        made = [path]
        return SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master=master, getCheckpointDir=lambda: made[-1], setCheckpointDir=made.append))

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared.shared_dir(on("yarn"))
    assert shared.shared_dir(on("yarn", "hdfs:///shared/")) == "hdfs:///shared"
    alone = on("local[2]")
    assert shared.shared_dir(alone) == shared.shared_dir(alone) and shared.shared_dir(alone).startswith("file:")


def test_summary_is_json_lines(spark, tmp_path):
    sinks.write_summary(spark.createDataFrame([("line_oee", 0.9)], "metric string, v double"), str(tmp_path / "s"))
    assert spark.read.json(str(tmp_path / "s")).first().metric == "line_oee"
