"""Wear curves: a signal against the time since the last maintenance, and straight-line fits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import div, sample_sd
from ..functions.moments import comoments, merge_comoments, merge_moments, moments, sd_of
from .asof import asof_maintenance
from .filters import FITTED_SHARE, filter_running, filter_signal, fitted_buckets


def age_bucket(bucket_s: int) -> Column:
    """Whole buckets since ``fresh``: milliseconds to seconds, then to buckets, both rounded down."""
    return div(div(F.col("ts_ms") - F.col("fresh"), 1000), bucket_s)


def _aged(telemetry: DataFrame, maintenance: DataFrame, signal: str, min_value: float | None, keep_unmatched: bool = False) -> DataFrame:
    """The signal's samples with the end of their last stop; signal and running samples are filtered before the join."""
    rows = filter_signal(telemetry, signal)
    if min_value is not None:
        rows = filter_running(rows, {signal: min_value})
    return asof_maintenance(rows, maintenance, keep_unmatched)


def _age_h(bucket_s: int) -> Column:
    return (F.col("bucket") * bucket_s / 3600.0).alias("age_h")


def degradation(telemetry: DataFrame, maintenance: DataFrame, signal: str = "torque", bucket_s: int = 1800, min_value: float | None = None) -> DataFrame:
    """(station, age_h, n, mean, sd): the signal's samples by age since the end of the last stop."""
    aged = _aged(telemetry, maintenance, signal, min_value)
    curve = aged.groupBy("station", age_bucket(bucket_s).alias("bucket")).agg(F.count("*").alias("n"), F.avg("value").alias("mean"), sample_sd(F.col("value")).alias("sd"))
    return curve.select("station", _age_h(bucket_s), "n", "mean", "sd")


def curve_partials(telemetry: DataFrame, maintenance: DataFrame, by: list[str], signal: str = "torque", bucket_s: int = 1800, min_value: float | None = None) -> DataFrame:
    """(station, bucket, by, n, mean, m2): the curve's figures of each part of the rows, such as a day.

    The part of a day needs the log up to that day only, as a sample's age goes back to an earlier stop.
    """
    return _aged(telemetry, maintenance, signal, min_value).groupBy("station", age_bucket(bucket_s).alias("bucket"), *by).agg(*moments(F.col("value")))


def curve_merge(partials: DataFrame, bucket_s: int = 1800) -> DataFrame:
    """The curve from partials of any split of its samples."""
    merged = merge_moments(partials, ["station", "bucket"])
    return merged.select("station", _age_h(bucket_s), "n", "mean", sd_of().alias("sd"))


def degradation_slopes(curve: DataFrame) -> DataFrame:
    """(station, slope_per_h, intercept, buckets): least squares over the fitted buckets.

    Stations with fewer than three of them, or all at one age, have no row.
    """
    fit = fitted_buckets(curve).groupBy("station").agg(F.regr_slope("mean", "age_h").alias("slope_per_h"), F.regr_intercept("mean", "age_h").alias("intercept"), F.count("*").alias("buckets"))
    return fit.filter("buckets >= 3 and slope_per_h is not null")


def slope_partials(fitted: DataFrame, by: list[Column]) -> DataFrame:
    """Co-moments of age and mean of the fitted buckets in each part, for lines fitted over parts of a curve."""
    return fitted.groupBy("station", *by).agg(*comoments(F.col("age_h"), F.col("mean")))


def slope_merge(partials: DataFrame) -> DataFrame:
    """``degradation_slopes`` from partials of any split of the fitted buckets."""
    merged = merge_comoments(partials, ["station"]).filter("n >= 3 and cxx > 0").withColumn("slope_per_h", F.col("cxy") / F.col("cxx"))
    return merged.select("station", "slope_per_h", (F.col("mean_y") - F.col("slope_per_h") * F.col("mean_x")).alias("intercept"), F.col("n").alias("buckets"))


def limits_and_slopes(telemetry: DataFrame, maintenance: DataFrame, signal: str = "torque", bucket_s: int = 1800, min_value: float | None = None) -> DataFrame:
    """(station, n, mean, sd, slope_per_h, intercept, buckets): a signal's spread and its wear by one pass over the samples.

    Samples are put together by age first, those before the first stop under no age; both figures come from these. A
    station that has no line has nulls for it.
    """
    aged = _aged(telemetry, maintenance, signal, min_value, keep_unmatched=True)
    parts = aged.groupBy("station", age_bucket(bucket_s).alias("bucket")).agg(*moments(F.col("value")))
    whole = Window.partitionBy("station")
    parts = parts.withColumns({"overall": F.sum(F.col("mean") * F.col("n")).over(whole) / F.sum("n").over(whole), "fullest": F.max(F.when(F.col("bucket").isNotNull(), F.col("n"))).over(whole)})
    off = F.col("mean") - F.col("overall")
    fitted = F.col("bucket").isNotNull() & (F.col("n") >= FITTED_SHARE * F.col("fullest"))
    y, x = F.when(fitted, F.col("mean")), F.when(fitted, F.col("bucket") * bucket_s / 3600.0)
    fit = [F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("at_zero"), F.count(x).alias("buckets")]
    table = parts.groupBy("station").agg(F.sum("n").alias("n"), F.first("overall").alias("mean"), F.sum(F.col("m2") + F.col("n") * off * off).alias("m2"), *fit)
    known = (F.col("buckets") >= 3) & F.col("slope").isNotNull()
    return table.select("station", "n", "mean", sd_of().alias("sd"), *(F.when(known, F.col(c)).alias(name) for c, name in (("slope", "slope_per_h"), ("at_zero", "intercept"), ("buckets", "buckets"))))


def degradation_points(curve: DataFrame, slopes: DataFrame, fitted_only: bool = False) -> DataFrame:
    """Curve points with ``rise_pct``, the rise above the fitted fresh value."""
    points = fitted_buckets(curve) if fitted_only else curve
    fresh = F.nullif(F.col("intercept"), F.lit(0.0))
    joined = points.join(slopes.select("station", "intercept"), "station", "left")
    return joined.select("station", "age_h", "n", F.col("mean").alias("mean_torque"), "sd", ((F.col("mean") / fresh - 1.0) * 100.0).alias("rise_pct"))


def find_fastest_wear(slopes: DataFrame) -> DataFrame:
    """The station of steepest slope, the first by name if several are."""
    return slopes.orderBy(F.desc("slope_per_h"), "station").limit(1).select("station", "slope_per_h")


def ordered_curve(curve: DataFrame) -> DataFrame:
    """The curve in order of station and age."""
    return curve.orderBy("station", "age_h")
