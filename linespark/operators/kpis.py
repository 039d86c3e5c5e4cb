"""Figures of a run over its planned horizon: per station and for the line."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import ratio
from ..schemas import SHIFT_MS


def station_kpis(part_events: DataFrame, maintenance: DataFrame | None, ideal: DataFrame, horizon_ms: int, run: str = "run") -> DataFrame:
    """Figures of each (run, station), ratios rounded half-even as they are published.

    Events and maintenance must be cut to the same days. ``maintenance`` has (run, station, event).
    """
    keys = [run, "station"]
    sums = part_events.groupBy(*keys).agg(
        F.count("*").alias("parts"), F.sum(F.when(F.col("status") == "PASS", 1).otherwise(0)).alias("good"),
        F.sum("cycle_ms").alias("run_ms"), F.sum("down_ms").alias("down_ms"), F.sum("blocked_ms").alias("blocked_ms"), F.sum("starved_ms").alias("starved_ms"),
    )
    rows = sums.join(ideal.select("station", "ideal_cycle_s"), "station", "left")
    if maintenance is None:
        rows = rows.withColumns({"preventive": F.lit(0).cast("long"), "corrective": F.lit(0).cast("long")})
    else:
        stops = maintenance.groupBy(*keys).agg(*(F.count(F.when(F.col("event") == e, 1)).alias(e) for e in ("preventive", "corrective")))
        rows = rows.join(stops, keys, "left").fillna(0, ["preventive", "corrective"])
    availability = F.greatest(F.lit(0.0), F.lit(float(horizon_ms)) - F.col("down_ms")) / float(horizon_ms)
    performance = F.least(F.lit(1.0), ratio(F.coalesce("ideal_cycle_s", F.lit(0.0)) * 1000.0 * F.col("parts"), F.col("run_ms")))
    quality = ratio(F.col("good"), F.col("parts"))
    idle = F.col("blocked_ms") + F.col("starved_ms")
    rounded = lambda c, n: F.bround(c, n)
    return rows.select(
        *keys, "parts", "good", "run_ms", "down_ms", "blocked_ms", "starved_ms", idle.alias("idle_ms"), "ideal_cycle_s", "preventive", "corrective",
        rounded(availability, 4).alias("availability"), rounded(performance, 4).alias("performance"), rounded(quality, 4).alias("quality"),
        rounded(availability * performance * quality, 4).alias("oee"), rounded(1.0 - quality, 5).alias("defect_rate"),
        rounded(ratio(F.col("run_ms"), F.col("run_ms") + idle), 4).alias("utilisation"), rounded(ratio(F.col("run_ms") / 1000.0, F.col("parts")), 3).alias("mean_cycle_s"),
    )


def line_kpis(kpis: DataFrame, days: int, run: str = "run") -> DataFrame:
    """Throughput, OEE, downtime and least idle station of each run's line."""
    return kpis.groupBy(run).agg(
        F.max_by("good", "station").alias("throughput_good_parts"),
        # Whole units are summed and rounded, so that a half is a half in binary as well.
        (F.bround(F.max_by("good", "station") * 10 / F.lit(days)) / 10).alias("throughput_per_day"),
        (F.bround(F.sum(F.round(F.col("oee") * 10000).cast("long")) / F.count("*")) / 10000).alias("line_oee"),
        (F.bround(F.sum("down_ms") / 36000.0) / 100).alias("total_downtime_h"),
        F.min_by("station", F.struct("idle_ms", "station")).alias("bottleneck_by_ground_truth"),
    )


def horizon(days: int) -> int:
    return days * SHIFT_MS
