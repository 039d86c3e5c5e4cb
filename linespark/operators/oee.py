"""OEE per station, and additive daily partials that merge without a rescan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import ratio
from .filters import assign_shift_day


#: Additive figures of cycles, and those of which the least or the largest counts.
SUMS = ("parts", "good", "cycle_ms", "down_ms", "blocked_ms", "starved_ms")


def partial_columns(counted: Column | None = None, prefix: str = "") -> list[Column]:
    """The additive figures of a group of cycles, or of those of them that are counted."""
    own = lambda c: c if counted is None else F.when(counted, c)
    columns = {
        "parts": F.count(own(F.lit(1))),
        "good": F.sum(F.when((F.col("status") == "PASS") & (F.lit(True) if counted is None else counted), 1).otherwise(0)),
        **{c: F.sum(own(F.col(c))) for c in SUMS[2:]},
        "min_cycle_ms": F.min(own(F.col("cycle_ms"))),
        "first_ts": F.min(own(F.col("ts_end_ms"))),
        "last_ts": F.max(own(F.col("ts_end_ms"))),
    }
    return [c.alias(prefix + name) for name, c in columns.items()]


def merged_columns(prefix: str = "") -> list[Column]:
    """The figures of several partials."""
    return [*(F.sum(prefix + c).alias(prefix + c) for c in SUMS), *(F.min(prefix + c).alias(prefix + c) for c in ("min_cycle_ms", "first_ts")), F.max(prefix + "last_ts").alias(prefix + "last_ts")]


def oee_partials(part_events: DataFrame, start_date: str = "1970-01-01", days: int = 1_000_000, by: tuple[str, ...] = ("station", "dt")) -> DataFrame:
    """Additive figures of each (station, day)."""
    rows = assign_shift_day(part_events, start_date, days, "ts_end_ms") if "dt" in by and "dt" not in part_events.columns else part_events
    return rows.filter("cycle_ms > 0").groupBy(*by).agg(*partial_columns())


def oee_merge(partials: DataFrame, ideal: DataFrame | None = None) -> DataFrame:
    """OEE of each station from partials of any split of its rows."""
    return oee_of_totals(partials.groupBy("station").agg(*merged_columns()), ideal)


def oee(part_events: DataFrame, ideal: DataFrame | None = None) -> DataFrame:
    """Availability, performance, quality and OEE of each station.

    ``ideal`` has (station, ideal_cycle_s): nameplate cycles of a line's few stations. A station
    without one falls back to its best cycle and has ``ideal_configured`` false.
    """
    return oee_of_totals(part_events.filter("cycle_ms > 0").groupBy("station").agg(*partial_columns()), ideal)


def oee_of_totals(total: DataFrame, ideal: DataFrame | None, *carried: str) -> DataFrame:
    """OEE of each station from its additive figures; carried columns stay."""
    if ideal is None:
        rows = total.withColumn("ideal_cycle_s", F.lit(None).cast("double"))
    else:
        rows = total.join(ideal.select("station", "ideal_cycle_s"), "station", "left")
    configured = F.coalesce(F.col("ideal_cycle_s") > 0, F.lit(False))
    rows = rows.withColumn("ideal_configured", configured).withColumn("ideal_cycle_s", F.when(configured, F.col("ideal_cycle_s")).otherwise(F.col("min_cycle_ms") / 1000.0))
    span = F.greatest(F.lit(1).cast("long"), F.col("last_ts") - F.col("first_ts"))
    rows = rows.withColumn("availability", F.greatest(F.lit(0.0), (span - F.col("down_ms")) / span))
    rows = rows.withColumn("performance", F.least(F.lit(1.0), ratio(F.col("ideal_cycle_s") * 1000.0 * F.col("parts"), F.col("cycle_ms"))))
    rows = rows.withColumn("quality", ratio(F.col("good"), F.col("parts")))
    return rows.select(
        "station", "parts", "good", (F.col("availability") * F.col("performance") * F.col("quality")).alias("oee"), "availability", "performance", "quality",
        (1.0 - F.col("quality")).alias("defect_rate"), "ideal_cycle_s", "ideal_configured", (F.col("min_cycle_ms") / 1000.0).alias("min_cycle_s"),
        (F.col("down_ms") / 1000.0).alias("down_s"), (F.col("blocked_ms") / 1000.0).alias("blocked_s"), (F.col("starved_ms") / 1000.0).alias("starved_s"), *carried,
    )


def melt_oee(table: DataFrame) -> DataFrame:
    """(station, factor, value): availability, performance and quality in long form."""
    return table.unpivot(["station"], ["availability", "performance", "quality"], "factor", "value")
