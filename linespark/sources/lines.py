"""Text sources: telemetry, part events, maintenance log and mined ``key=value`` rows.

Files lie in folders ``dt=.../station=...`` though the station is also a field of each line, so
lines are read as text and split: partition columns come along under names of their own
(``dt``, ``dir_station``), and the number of fields stays known for malformed rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """All lines below ``path`` with their fields; empty lines are left out."""
    lines = spark.read.text(path)
    if "station" in lines.columns:
        lines = lines.withColumnRenamed("station", "dir_station")
    return lines.filter(F.length("value") > 0).withColumn("fields", F.split("value", ",", -1)).withColumnRenamed("value", "line")


def _text(i: int) -> Column:
    return F.trim(F.get("fields", F.lit(i)))


def _number(i: int, kind: str) -> Column:
    return _text(i).try_cast(kind)


def parse_telemetry(lines: DataFrame) -> DataFrame:
    """Typed columns beside the line; a number that can't be parsed is null."""
    return lines.withColumns({"ts_ms": _number(0, "long"), "station": _text(1), "signal": _text(2), "sample": _number(3, "double")})


def parse_part_events(lines: DataFrame) -> DataFrame:
    """Typed columns beside the line; a missing defect code is empty."""
    return lines.withColumns(
        {"ts_end_ms": _number(0, "long"), "station": _text(1), "part_id": _number(2, "long"), "cycle_ms": _number(3, "long"), "blocked_ms": _number(4, "long"), "starved_ms": _number(5, "long"), "down_ms": _number(6, "long"), "status": _text(7), "defect_code": F.coalesce(_text(8), F.lit(""))}
    )


def read_telemetry(spark: SparkSession, path: str) -> DataFrame:
    """Telemetry rows that parse; headers and malformed lines are left out."""
    rows = parse_telemetry(read_lines(spark, path)).filter((F.size("fields") >= 4) & F.col("ts_ms").isNotNull() & (F.col("station") != "") & F.col("sample").isNotNull())
    return rows.select("ts_ms", "station", "signal", F.col("sample").alias("value"), *(["dt"] if "dt" in rows.columns else []))


def read_part_events(spark: SparkSession, path: str) -> DataFrame:
    """Part events that parse; headers and malformed lines are left out."""
    rows = parse_part_events(read_lines(spark, path))
    numbers = F.lit(True)
    for c in ("ts_end_ms", "part_id", "cycle_ms", "blocked_ms", "starved_ms", "down_ms"):
        numbers &= F.col(c).isNotNull()
    rows = rows.filter((F.size("fields") >= 8) & numbers & (F.col("station") != ""))
    return rows.select("ts_end_ms", "station", "part_id", "cycle_ms", "blocked_ms", "starved_ms", "down_ms", "status", "defect_code", *(["dt"] if "dt" in rows.columns else []))


def read_maintenance(spark: SparkSession, path: str) -> DataFrame:
    """The maintenance log; header, blank, short and unparsable lines are left out."""
    rows = read_lines(spark, path).select(_number(0, "long").alias("ts_ms"), _text(1).alias("station"), _text(2).alias("event"), _number(3, "long").alias("duration_ms"), F.size("fields").alias("n"))
    return rows.filter("n >= 4 and ts_ms is not null and duration_ms is not null").drop("n")


def ordered_log(maintenance: DataFrame) -> DataFrame:
    """The log in order of time, then station, event and duration."""
    return maintenance.orderBy("ts_ms", "station", "event", "duration_ms")


def read_kv_rows(spark: SparkSession, path: str) -> DataFrame:
    """(key, values, extra) of mined text files; hidden files such as ``_SUCCESS`` are left out by Spark."""
    return parse_kv_rows(spark.read.text(path))


def parse_kv_rows(lines: DataFrame) -> DataFrame:
    """(key, values) of mined text rows ``key <tab> k=v <tab> k=v``; parts without ``=`` are kept in ``extra``."""
    lines = lines.filter(F.length(F.trim("value")) > 0)
    parts = F.split("value", "\t", -1)
    rest = F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0)))
    pairs = F.filter(rest, lambda p: p.contains("="))
    cut = F.transform(pairs, lambda p: F.struct(F.trim(F.substring_index(p, "=", 1)).alias("k"), F.trim(F.substr(p, F.instr(p, "=") + 1)).alias("v")))
    last = F.aggregate(cut, F.create_map().cast("map<string,string>"), lambda m, kv: F.map_concat(F.map_filter(m, lambda k, v: k != kv["k"]), F.create_map(kv["k"], kv["v"])))
    return lines.select(F.trim(parts[0]).alias("key"), last.alias("values"), F.transform(F.filter(rest, lambda p: ~p.contains("=")), F.trim).alias("extra"))
