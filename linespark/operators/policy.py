"""The next control policy from mined figures, for many lines and parameter pairs in one job."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schemas import POLICY_FIELDS

# Bounds of the maintenance interval in cycles and of the buffer.
PM_MIN_CYCLES, PM_MAX_CYCLES = 400, 20000
BUFFER_MIN, BUFFER_MAX = 4, 24
TARGET_RISE = 0.15


def station_table(stations: DataFrame, oee: DataFrame, bott: DataFrame, limits: DataFrame, slopes: DataFrame) -> DataFrame:
    """One row for each station with its OEE, utilisation, torque and wear figures; missing ones are null."""
    out = stations.select("station").join(oee.select("station", "oee", "availability", "performance", "quality", "defect_rate"), "station", "left")
    out = out.join(bott.select("station", "utilisation", "mean_cycle_s", "blocked_s", "starved_s"), "station", "left")
    out = out.join(limits.select("station", F.col("mean").alias("torque_mean"), F.col("sd").alias("torque_sd")), "station", "left")
    return out.join(slopes.select("station", "slope_per_h", F.col("intercept").alias("fresh_torque")), "station", "left")


def station_table_of(stations: DataFrame, cycles: DataFrame, torque: DataFrame) -> DataFrame:
    """``station_table`` from ``oee_and_bottleneck`` and ``limits_and_slopes``: cycles and samples are read once each."""
    own = cycles.select("station", *(f"oee.{c}" for c in ("oee", "availability", "performance", "quality", "defect_rate")), *(f"bottleneck.{c}" for c in ("utilisation", "mean_cycle_s", "blocked_s", "starved_s")))
    torque = torque.select("station", F.col("mean").alias("torque_mean"), F.col("sd").alias("torque_sd"), "slope_per_h", F.col("intercept").alias("fresh_torque"))
    return stations.select("station").join(own, "station", "left").join(torque, "station", "left")


def _synthesised(base: DataFrame, mined: DataFrame, sigma: Column, rise: Column, line: list[str]) -> DataFrame:
    """Base rows with new set points; ``mined`` has mean, sd, utilisation, mean_cycle_s, slope_per_h and intercept by station."""
    rows = base.join(mined, [*line, "station"], "left")
    constraint = F.col("constraint")
    whole = Window.partitionBy(*line)
    rows = rows.withColumns({"feeds": F.lead("station").over(whole.orderBy("station")), "limits_met": F.count("mean").over(whole), "cycles_met": F.count("utilisation").over(whole)})
    wide = (F.col("station") == constraint) | F.coalesce(F.col("feeds") == constraint, F.lit(False))
    buffer = F.when(wide, F.greatest(F.lit(BUFFER_MIN), F.least(F.lit(BUFFER_MAX), F.bround(F.col("buffer_capacity") * 1.5).cast("long")))).otherwise(F.col("buffer_capacity"))
    cycle = F.when(F.col("utilisation") > 0, F.col("mean_cycle_s") / F.col("utilisation")).otherwise(F.col("mean_cycle_s"))
    fits = (F.col("slope_per_h") > 1e-9) & (F.col("intercept") > 0) & (cycle > 0) & F.col("mean").isNotNull()
    hours = rise * F.col("intercept") / F.when(fits, F.col("slope_per_h"))
    interval = F.greatest(F.lit(PM_MIN_CYCLES), F.least(F.lit(PM_MAX_CYCLES), F.bround(hours * 3600.0 / F.when(fits, cycle)).cast("long")))
    limit = lambda sign: F.bround(F.col("mean") + sign * sigma * F.col("sd"), 3)
    new = {
        "torque_lcl": F.coalesce(limit(-1), F.col("torque_lcl")),
        "torque_ucl": F.coalesce(limit(1), F.col("torque_ucl")),
        "pm_interval_cycles": F.coalesce(F.when(F.coalesce(fits, F.lit(False)), interval), F.col("pm_interval_cycles")).cast("long"),
        "buffer_capacity": buffer.cast("long"),
    }
    # Without any input for a line there is no policy; this is found while the rows are made, not by a pass of its own.
    missing = F.when(F.col("limits_met") == 0, "no control limits for the line's stations").when(F.col("cycles_met") == 0, "no utilisation of the line's stations")
    # A condition on the rows holds whichever columns are asked for.
    rows = rows.filter(F.when(missing.isNotNull(), F.raise_error(missing).cast("boolean")).otherwise(F.lit(True)))
    return rows.select(*line, "station", *(new.get(c, F.col(c)).alias(c) for c in POLICY_FIELDS))


def mined_table(limits: DataFrame, bott: DataFrame, slopes: DataFrame | None, line: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """What the policy needs of each (line, station), as rounded in the job outputs; and each line's constraint.

    Without ``slopes`` the limits have them as well (``limits_and_slopes``).
    """
    line = line or []
    keys = [*line, "station"]
    four = lambda c: F.round(c, 4).alias(c)
    used = bott.select(*keys, four("utilisation"), F.round("mean_cycle_s", 3).alias("mean_cycle_s"))
    order = Window.partitionBy(*line).orderBy(F.desc("utilisation"), "station")
    first = used.withColumn("nth", F.row_number().over(order)).filter("nth = 1").select(*line, F.col("station").alias("constraint"))
    wear = ["slope_per_h", "intercept"]
    found = limits.select(*keys, four("mean"), four("sd"), *(wear if slopes is None else [])).join(used, keys, "full")
    return found if slopes is None else found.join(slopes.select(*keys, *wear), keys, "left"), first


def synthesise_policy(base: DataFrame, limits: DataFrame, bott: DataFrame, slopes: DataFrame | None = None, sigma: float = 3.0, target_rise: float = TARGET_RISE, policy_id: str = "B-mined", line: list[str] | None = None) -> DataFrame:
    """One row for each (line, station) of the base policy with new limits, intervals and buffers.

    A line for whose stations there are no limits or no utilisation at all raises an error.
    """
    line = line or []
    mined, first = mined_table(limits, bott, slopes, line)
    # Without lines the constraint is one row.
    own = base.join(first, line, "left") if line else base.join(F.broadcast(first), F.lit(True), "left")
    out = _synthesised(own, mined, F.lit(sigma), F.lit(target_rise), line)
    told = F.lit(f"mined: control limits at {sigma:g} sigma, maintenance at a rise of {target_rise:.0%}, buffers around the constraint")
    return out.withColumns({"policy_id": F.lit(policy_id), "provenance": told})


def policy_grid(base: DataFrame, limits: DataFrame, bott: DataFrame, slopes: DataFrame | None, sigmas: list[float], rises: list[float]) -> DataFrame:
    """Policies for all pairs of parameters: (sigma, target_rise, station, ..). The grid is as small as the given lists."""
    spark = base.sparkSession
    grid = spark.createDataFrame([(float(s), float(r)) for s in sigmas for r in rises], "sigma double, target_rise double")
    mined, first = mined_table(limits, bott, slopes)
    # Parameter pairs times mined aggregates: each pair is a line of its own. The pairs are as few as the lists, the constraint is one row.
    cells = base.join(F.broadcast(first), F.lit(True), "left").crossJoin(F.broadcast(grid))
    return _synthesised(cells, mined.crossJoin(F.broadcast(grid)), F.col("sigma"), F.col("target_rise"), ["sigma", "target_rise"])


def _long(policy: DataFrame, name: str) -> DataFrame:
    fields = [F.col(c).cast("double").alias(c) for c in POLICY_FIELDS if c != "ideal_cycle_s"]
    return policy.select("station", *fields).unpivot(["station"], [c for c in POLICY_FIELDS if c != "ideal_cycle_s"], "field", name)


def policy_diff(a: DataFrame, b: DataFrame) -> DataFrame:
    """(station, field, A, B, changed) of two policies."""
    both = _long(a, "A").join(_long(b, "B"), ["station", "field"], "full")
    return both.withColumn("changed", ~F.col("A").eqNullSafe(F.col("B")))


def pivot_policy(diff: DataFrame, value: str = "B") -> DataFrame:
    """(station, one column for each field)."""
    return diff.groupBy("station").pivot("field", [c for c in POLICY_FIELDS if c != "ideal_cycle_s"]).agg(F.first(value))


def stack_policies(a: DataFrame, b: DataFrame) -> DataFrame:
    """(policy, station, torque_lcl, torque_ucl): limits of two policies under each other."""
    part = lambda df, name: df.select(F.lit(name).alias("policy"), "station", "torque_lcl", "torque_ucl")
    return part(a, "A").unionByName(part(b, "B"))
