"""Row classes of raw lines, counts per class, and records per station.

Each job has rules of its own; the order of the tests is part of them.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.moments import moments
from ..sources.lines import parse_part_events, parse_telemetry
from .asof import asof_maintenance
from .bottleneck import CHUNK_MS, run_chunks
from .degradation import age_bucket
from .limits import moment_partials
from .oee import partial_columns


def _known(*names: str) -> Column:
    return reduce(lambda a, b: a & b, (F.col(n).isNotNull() for n in names))


def classify_oee(lines: DataFrame) -> DataFrame:
    """HEADER, MALFORMED or PARSED; a cycle must take longer than 0 ms."""
    rows = parse_part_events(lines)
    good = (F.size("fields") >= 8) & _known("ts_end_ms", "cycle_ms", "blocked_ms", "starved_ms", "down_ms") & (F.col("station") != "") & (F.col("cycle_ms") > 0)
    return rows.withColumn("class", F.when(F.col("line").startswith("ts_end_ms"), "HEADER").when(good, "PARSED").otherwise("MALFORMED"))


def classify_bottleneck(lines: DataFrame) -> DataFrame:
    """MALFORMED or PARSED; headers are left out, and cycles of 0 ms are kept."""
    rows = parse_part_events(lines).filter(~F.col("line").startswith("ts_end_ms"))
    good = (F.size("fields") >= 8) & _known("ts_end_ms", "cycle_ms", "blocked_ms", "starved_ms") & (F.col("station") != "")
    return rows.withColumn("class", F.when(good, "PARSED").otherwise("MALFORMED"))


def classify_limits(lines: DataFrame, signal: str, min_value: float = float("-inf")) -> DataFrame:
    """HEADER, MALFORMED, FILTERED_OTHER_SIGNAL, FILTERED_NOT_RUNNING or KEPT; the station is tested before the signal, the time isn't."""
    found = (
        F.when(F.col("line").startswith("ts_ms"), "HEADER")
        .when((F.size("fields") < 4) | (F.col("station") == ""), "MALFORMED")
        .when(F.col("signal") != signal, "FILTERED_OTHER_SIGNAL")
        .when(F.col("sample").isNull(), "MALFORMED")
        .when(F.col("sample") < F.lit(min_value), "FILTERED_NOT_RUNNING")
        .otherwise("KEPT")
    )
    return parse_telemetry(lines).withColumn("class", found)


def classify_degradation(lines: DataFrame, maintenance: DataFrame, signal: str, min_value: float = float("-inf")) -> DataFrame:
    """MALFORMED, FILTERED_OTHER_SIGNAL, FILTERED_NOT_RUNNING, NO_MAINTENANCE_YET or JOINED; headers are left out, an empty station isn't malformed."""
    rows = parse_telemetry(lines).filter(~F.col("line").startswith("ts_ms")).withColumnRenamed("sample", "value")
    found = (
        F.when(F.size("fields") < 4, "MALFORMED")
        .when(F.col("signal") != signal, "FILTERED_OTHER_SIGNAL")
        .when(~_known("ts_ms", "value"), "MALFORMED")
        .when(F.col("value") < F.lit(min_value), "FILTERED_NOT_RUNNING")
        .when(F.col("fresh").isNull(), "NO_MAINTENANCE_YET")
        .otherwise("JOINED")
    )
    return asof_maintenance(rows, maintenance, keep_unmatched=True).withColumn("class", found)


def quality_report(classified: DataFrame) -> DataFrame:
    """(class, n, other_signal_pct): rows of each class, and the share of rows that the signal filter removed."""
    counts = classified.groupBy("class").agg(F.count("*").alias("n"))
    # The counts are a handful of rows, so one window holds them all.
    of = lambda *names: F.sum(F.when(F.col("class").isin(*names), F.col("n")).otherwise(0)).over(Window.partitionBy())
    kept, other = of("KEPT", "JOINED"), of("FILTERED_OTHER_SIGNAL")
    return counts.select("class", "n", F.when(kept + other > 0, 100.0 * other / (kept + other)).alias("other_signal_pct"))


#: Classes of the rows that a job's results are made of.
MINED = ("PARSED", "KEPT", "JOINED")


def _mined(classified: DataFrame, *keys: str) -> DataFrame:
    """Classified rows of which only those that are mined keep the keys of their results."""
    return classified.withColumns({k: F.when(F.col("class").isin(*MINED), F.col(k)) for k in keys})


def mine_oee(lines: DataFrame) -> DataFrame:
    """OEE partials of each class and station: results (``oee_merge`` of ``mined_rows``) and class counts by one scan.

    Counts kept in accumulators would count twice what is run again after an executor is lost; these are rows.
    """
    return _mined(classify_oee(lines), "station").groupBy("class", "station").agg(*partial_columns(), F.count("*").alias("rows"))


def mine_bottleneck(lines: DataFrame, chunk_ms: int = CHUNK_MS) -> DataFrame:
    """``run_chunks`` of each class; rows that aren't mined are dealt over chunks of their own."""
    return run_chunks(_mined(classify_bottleneck(lines), "station"), chunk_ms, ["class"], F.when(~F.col("class").isin(*MINED), -1 - F.pmod(F.xxhash64("line"), F.lit(4096)))).withColumn("rows", F.col("len"))


def mine_limits(lines: DataFrame, signal: str, min_value: float = float("-inf")) -> DataFrame:
    """Moments of each class, station and signal."""
    rows = _mined(classify_limits(lines, signal, min_value).withColumn("value", F.col("sample")), "station", "signal")
    return moment_partials(rows, ["class"]).withColumn("rows", F.col("n"))


def mine_degradation(lines: DataFrame, maintenance: DataFrame, signal: str, min_value: float = float("-inf"), bucket_s: int = 1800) -> DataFrame:
    """Moments of each class, station and age bucket."""
    rows = classify_degradation(lines, maintenance, signal, min_value).withColumn("bucket", age_bucket(bucket_s))
    return _mined(rows, "station", "bucket").groupBy("class", "station", "bucket").agg(*moments(F.col("value"))).withColumn("rows", F.col("n"))


def mined_rows(mined: DataFrame) -> DataFrame:
    return mined.filter(F.col("class").isin(*MINED))


def class_counts(mined: DataFrame) -> DataFrame:
    """(class, n) of a job's lines from what was mined."""
    return mined.groupBy("class").agg(F.sum("rows").alias("n"))


def count_per_station(lines: DataFrame) -> DataFrame:
    """(station, records, malformed): good records of each untrimmed station; malformed ones under a null station."""
    rows = lines.filter(~F.col("line").startswith("timestamp")).withColumn("raw", F.get("fields", F.lit(1)))
    good = (F.size("fields") >= 4) & (F.col("raw") != "")
    return rows.groupBy(F.when(good, F.col("raw")).alias("station")).agg(F.count(F.when(good, 1)).alias("records"), F.count(F.when(~good, 1)).alias("malformed"))
