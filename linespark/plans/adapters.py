"""The line's input tables made of the star-schema tables, alike in Spark and in SQL text.

The expressions are plain SQL that both engines read; only the conversion of a time to
milliseconds (``MS``) differs.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

E0 = ["event_id", "MS(ts) ts_ms", "concat('S0', cast(user_id % 6 + 1 as varchar(10))) station", "event_type", "value"]
TELEMETRY = [
    "ts_ms", "station",
    "case event_type when 'click' then 'torque' when 'view' then 'motor_temp' when 'purchase' then 'vibration' else 'spindle_load' end signal",
    "value",
]
MAINTENANCE = [
    "ts_ms", "station", "case when value >= 200 then 'corrective' else 'preventive' end event", "cast(round(value * 1000) as bigint) duration_ms",
    "case when event_id % 2 = 0 then 'A' else 'B' end arm", "cast((event_id % 40 - event_id % 2) / 2 as bigint) + 1 seed",
]
PART_EVENTS = [
    "MS(l_shipdate) + cast(l_linenumber as bigint) * 3600000 ts_end_ms", "concat('S0', cast(l_suppkey % 6 + 1 as varchar(10))) station", "l_orderkey part_id",
    "cast(l_quantity as bigint) * 200 + 8000 cycle_ms",
    "case when cast(round(l_discount * 100) as bigint) >= 6 then cast(round(l_discount * 100) as bigint) * 1000 else 0 end blocked_ms",
    "case when cast(round(l_discount * 100) as bigint) <= 2 then (3 - cast(round(l_discount * 100) as bigint)) * 1000 else 0 end starved_ms",
    "cast(case when l_quantity = 50 then 240000 when l_quantity = 49 and l_linenumber = 7 then 1500000 else 0 end as bigint) down_ms",
    "case when l_returnflag = 'R' then 'FAIL' else 'PASS' end status",
    "case when l_returnflag <> 'R' then '' when l_linestatus = 'F' then 'misalign' else 'surface' end defect_code",
    "case when l_linestatus = 'F' then 'A' else 'B' end arm", "l_partkey % 20 + 1 seed",
]
#: Raw lines with every kind of fault, by the event's number.
LINES = [
    "case when event_id % 97 = 0 then concat(cast(ts_ms as varchar(20)), ',', station) when event_id % 89 = 0 then concat(cast(ts_ms as varchar(20)), ',,torque,7.5') "
    "when event_id % 83 = 0 then concat(cast(ts_ms as varchar(20)), ',', station, ',torque,x') when event_id % 79 = 0 then 'ts_ms,station,signal,value' "
    "else concat(cast(ts_ms as varchar(20)), ',', station, ',', case event_type when 'click' then 'torque' else 'vibration' end, ',', case when value < 5 then '4.5' else '9.5' end) end value",
]
TEXT = "concat(cast(ts_end_ms as varchar(20)), ',', {station}, ',', cast(part_id as varchar(20)), ',', {cycle}, ',', cast(blocked_ms as varchar(20)), ',', cast(starved_ms as varchar(20)), ',', cast(down_ms as varchar(20)), ',', status{code})"
CYCLE, CODE = "cast(cycle_ms as varchar(20))", ", ',', defect_code"
#: Raw lines of part events with every kind of fault, by the part's number.
EVENT_LINES = [
    "case when part_id % 97 = 0 then concat(cast(ts_end_ms as varchar(20)), ',', station, ',', cast(part_id as varchar(20))) "
    f"when part_id % 89 = 0 then {TEXT.format(station=repr(''), cycle=CYCLE, code=CODE)} when part_id % 83 = 0 then {TEXT.format(station='station', cycle=repr('x'), code=CODE)} "
    f"when part_id % 79 = 0 then 'ts_end_ms,station,part_id,cycle_ms,blocked_ms,starved_ms,down_ms,status,defect_code' when part_id % 73 = 0 then {TEXT.format(station='station', cycle=repr('0'), code=CODE)} "
    f"when part_id % 71 = 0 then {TEXT.format(station='station', cycle=CYCLE, code='')} else {TEXT.format(station='station', cycle=CYCLE, code=CODE)} end value",
]
#: Raw lines of the maintenance log, with headers and short lines.
LOG_LINES = [
    "case when ts_ms % 11 = 0 then concat(cast(ts_ms as varchar(20)), ',', station) when ts_ms % 13 = 0 then 'ts_ms,station,event,duration_ms' "
    "else concat(cast(ts_ms as varchar(20)), ',', station, ',', event, ',', cast(duration_ms as varchar(20))) end value",
]
# The base policy's limits, interval, buffer and nameplate cycle of each station.
BASE = [
    ("S01", 1.0, 23.6, 32.4, 3000, 8, 11.0), ("S02", 1.0, 34.8, 53.2, 3000, 8, 12.5), ("S03", 1.0, 32.2, 45.8, 3000, 8, 14.8),
    ("S04", 1.0, 27.2, 38.8, 3000, 8, 12.0), ("S05", 1.0, 14.8, 21.2, 3000, 8, 10.5), ("S06", 1.0, 20.0, 28.0, 3000, 8, 11.2),
]
BASE_FIELDS = "station string, speed_setpoint double, torque_lcl double, torque_ucl double, pm_interval_cycles long, buffer_capacity long, ideal_cycle_s double"


def _spark(exprs: list[str]) -> list[str]:
    return [re.sub(r"MS\((\w+)\)", r"timestampdiff(MILLISECOND, timestamp_ntz'1970-01-01 00:00:00', cast(\1 as timestamp_ntz))", e).replace("varchar(10)", "string").replace("varchar(20)", "string") for e in exprs]


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet").selectExpr(*_spark(E0))


def telemetry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _events(spark, sf_dir).filter("event_type <> 'error'").selectExpr(*_spark(TELEMETRY))


def maintenance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _events(spark, sf_dir).filter("event_type = 'error' and value >= 100").selectExpr(*_spark(MAINTENANCE))


def part_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/lineitem.parquet").selectExpr(*_spark(PART_EVENTS))


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _events(spark, sf_dir).selectExpr(*_spark(LINES))


def event_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return part_events(spark, sf_dir).selectExpr(*_spark(EVENT_LINES))


def log_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maintenance(spark, sf_dir).selectExpr(*_spark(LOG_LINES))


def base_policy(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(BASE, BASE_FIELDS)


def ideal_cycles(spark: SparkSession, without: str | None = None) -> DataFrame:
    rows = [(r[0], None if r[0] == without else r[6]) for r in BASE]
    return spark.createDataFrame(rows, "station string, ideal_cycle_s double")


def sql_tables() -> str:
    """The same tables as common table expressions for DuckDB."""
    duck = lambda exprs: ", ".join(re.sub(r"MS\((\w+)\)", r"(epoch_us(\1) // 1000)", e) for e in exprs)
    values = ", ".join("(" + ", ".join(repr(v) if isinstance(v, str) else f"{v}::{'bigint' if isinstance(v, int) else 'double'}" for v in r) + ")" for r in BASE)
    names = ", ".join(f.split()[0] for f in BASE_FIELDS.split(", "))
    return f"""
e0 as (select {duck(E0)} from events),
telemetry as (select {duck(TELEMETRY)} from e0 where event_type <> 'error'),
maintenance as (select {duck(MAINTENANCE)} from e0 where event_type = 'error' and value >= 100),
part_events as (select {duck(PART_EVENTS)} from lineitem),
raw_lines as (select {duck(LINES)} from e0),
event_lines as (select {duck(EVENT_LINES)} from part_events),
log_lines as (select {duck(LOG_LINES)} from maintenance),
base as (select * from (values {values}) t({names}))"""
