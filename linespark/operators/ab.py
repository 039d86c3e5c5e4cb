"""Paired comparison of two policies over the same seeds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Metrics with their labels and the better direction.
METRICS = [
    ("throughput_good_parts", "throughput (good parts)", "higher"),
    ("total_downtime_h", "maintenance downtime (h)", "lower"),
    ("line_oee", "line OEE", "higher"),
]


def _once(arm: str) -> Column:
    """The arm's one value; a seed that ran twice is refused rather than picked from."""
    own = F.when(F.col("arm") == arm, F.col("value"))
    return F.when(F.count(own) > 1, F.raise_error(F.concat(F.lit(f"arm {arm} has several runs of seed "), F.first("seed").cast("string")))).otherwise(F.max(own))


def pair_arms(runs: DataFrame, a: str = "A", b: str = "B") -> DataFrame:
    """(seed, metric, a, b) of one table of runs with their ``arm``, one for each arm and seed, in one pass."""
    names = [m for m, _, _ in METRICS]
    long = runs.select("seed", "arm", *(F.col(m).cast("double").alias(m) for m in names)).unpivot(["seed", "arm"], names, "metric", "value")
    return long.groupBy("seed", "metric").agg(_once(a).alias("a"), _once(b).alias("b")).filter("a is not null and b is not null")


def pair_runs(a: DataFrame, b: DataFrame) -> DataFrame:
    """``pair_arms`` of two tables of runs."""
    names = ["seed", *(m for m, _, _ in METRICS)]
    return pair_arms(a.select(*names).withColumn("arm", F.lit("A")).unionByName(b.select(*names).withColumn("arm", F.lit("B"))))


def paired_ci(pairs: DataFrame) -> DataFrame:
    """Means of both arms and of the differences, with a 95 % interval (0 for a single pair)."""
    delta = F.col("b") - F.col("a")
    half = F.when(F.count("*") < 2, 0.0).otherwise(1.96 * F.stddev_samp(delta) / F.sqrt(F.count("*")))
    out = pairs.groupBy("metric").agg(F.count("*").alias("n"), F.avg("a").alias("a_mean"), F.avg("b").alias("b_mean"), F.avg(delta).alias("delta_mean"), half.alias("delta_ci95"))
    return out.withColumn("delta_pct", F.when(F.col("a_mean") != 0, F.col("delta_mean") / F.nullif(F.col("a_mean"), F.lit(0.0)) * 100.0).otherwise(0.0))


def ab_table(ci: DataFrame) -> DataFrame:
    """One row a metric with its verdict: no effect, B better or B WORSE; the interval also in percent of A."""
    label = direction = F.lit(None).cast("string")
    for name, text, way in METRICS:
        label = F.when(F.col("metric") == name, text).otherwise(label)
        direction = F.when(F.col("metric") == name, way).otherwise(direction)
    rows = ci.withColumns({"label": label, "direction": direction, "significant": F.abs("delta_mean") > F.col("delta_ci95")})
    better = F.when(F.col("direction") == "higher", F.col("delta_mean") > 0).otherwise(F.col("delta_mean") < 0)
    verdict = F.when(~F.col("significant"), "no effect").when(better, "B better").otherwise("B WORSE")
    a, ci95 = F.bround("a_mean", 4), F.bround("delta_ci95", 4)
    return rows.select(
        "metric", "label", "direction", a.alias("a_mean"), F.bround("b_mean", 4).alias("b_mean"), F.bround("delta_mean", 4).alias("delta_mean"), ci95.alias("delta_ci95"),
        F.bround("delta_pct", 3).alias("delta_pct"), F.when(a != 0, ci95 / F.nullif(a, F.lit(0.0)) * 100.0).otherwise(0.0).alias("ci_pct"), "significant", verdict.alias("verdict"),
    )
