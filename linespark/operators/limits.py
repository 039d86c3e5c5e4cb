"""Control limits per station and signal, mergeable moments, and the bias of stopped samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import not_nan, sample_sd
from ..functions.moments import merge_moments, moments, sd_of
from .filters import filter_running, fitted_buckets

KEYS = ("station", "signal")


def _samples(telemetry: DataFrame, signals: list[str] | None, min_values: dict[str, float] | None) -> DataFrame:
    rows = telemetry if signals is None else telemetry.filter(F.col("signal").isin(signals))
    return filter_running(rows, min_values) if min_values else rows


def _with_limits(stats: DataFrame, k: float) -> DataFrame:
    return stats.select(*KEYS, "n", "mean", "sd", (F.col("mean") - k * F.col("sd")).alias("lcl"), (F.col("mean") + k * F.col("sd")).alias("ucl"), "min", "max")


def control_limits(telemetry: DataFrame, signals: list[str] | None = None, k: float = 3.0, min_values: dict[str, float] | None = None) -> DataFrame:
    """n, mean, sd, mean -+ k sd, least and largest value of each station and signal, in one pass.

    NaN samples are kept: they make mean and sd NaN, while least and largest leave them out.
    """
    value = F.col("value")
    stats = _samples(telemetry, signals, min_values).groupBy(*KEYS).agg(F.count("*").alias("n"), F.avg(value).alias("mean"), sample_sd(value).alias("sd"), F.min(not_nan(value)).alias("min"), F.max(not_nan(value)).alias("max"))
    return _with_limits(stats, k)


def _least_and_largest() -> list[Column]:
    return [F.min(not_nan(F.col("value"))).alias("min"), F.max(not_nan(F.col("value"))).alias("max")]


def moment_partials(telemetry: DataFrame, by: list[str], signals: list[str] | None = None, min_values: dict[str, float] | None = None) -> DataFrame:
    """n, mean, sum of squared deviations, least and largest value of each part of the rows."""
    return _samples(telemetry, signals, min_values).groupBy(*KEYS, *by).agg(*moments(F.col("value")), *_least_and_largest())


def moment_merge(partials: DataFrame, k: float = 3.0) -> DataFrame:
    """Limits from partials of any split, such as those of stored days."""
    merged = merge_moments(partials, list(KEYS), F.min("min").alias("min"), F.max("max").alias("max"))
    return _with_limits(merged.withColumn("sd", sd_of()), k)


def filter_bias(aged: DataFrame, min_value: float, bucket_s: int = 1800) -> DataFrame:
    """(station, sd and slope of the wear curve with and without stopped samples, ratio of the slopes).

    ``aged`` are samples of one signal with ``fresh``, as ``asof_maintenance`` gives them.
    """
    from .degradation import age_bucket

    value, runs = F.col("value"), ~(F.col("value") < min_value)
    rows = aged.withColumn("bucket", age_bucket(bucket_s))
    spread = rows.groupBy("station").agg(sample_sd(F.when(runs, value)).alias("sd_running"), sample_sd(value).alias("sd_all"))
    curve = rows.groupBy("station", "bucket").agg(F.count(F.when(runs, 1)).alias("n_running"), F.avg(F.when(runs, value)).alias("mean_running"), F.count("*").alias("n_all"), F.avg(value).alias("mean_all"))
    age = F.col("bucket") * bucket_s / 3600.0
    out = spread
    for kind in ("running", "all"):
        one = fitted_buckets(curve.filter(F.col(f"n_{kind}") > 0).select("station", age.alias("age_h"), F.col(f"n_{kind}").alias("n"), F.col(f"mean_{kind}").alias("mean")))
        out = out.join(one.groupBy("station").agg(F.when(F.count("*") >= 3, F.regr_slope("mean", "age_h")).alias(f"slope_{kind}")), "station", "left")
    return out.withColumn("slope_ratio", F.col("slope_all") / F.nullif(F.col("slope_running"), F.lit(0.0)))
