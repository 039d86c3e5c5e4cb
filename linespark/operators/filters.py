"""Filters and projections: signals, running samples, scored days, production days, thin buckets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import div
from ..schemas import SHIFT_MS


def filter_signal(df: DataFrame, signal: str) -> DataFrame:
    """Samples of one signal; pushed down to the scan."""
    return df.filter(F.col("signal") == signal)


def filter_running(df: DataFrame, min_values: dict[str, float]) -> DataFrame:
    """Drop samples of a stopped machine: below the least value of their own signal. NaN stays."""
    least = F.lit(float("-inf"))
    for signal, value in sorted(min_values.items()):
        least = F.when(F.col("signal") == signal, F.lit(float(value))).otherwise(least)
    return df.filter(~(F.col("value") < least))


def score_window(events: DataFrame, split_days: int, start_ms: int | Column = 0) -> DataFrame:
    """Cycles that end at least ``split_days`` shifts after the start of the clock, a number or a column of the events."""
    return events.filter(F.col("ts_end_ms") >= start_ms + split_days * SHIFT_MS)


def score_stored_days(stored: DataFrame, starts: DataFrame) -> DataFrame:
    """Rows of stored runs from each run's first scored day on; ``starts`` has (run, first_dt), a row for each run to score.

    ``stored`` is partitioned by run and day. Folders are left unread in two ways: those before the earliest start by a filter known
    beforehand, and other runs' by the runs of ``starts`` (dynamic pruning). ``starts`` are as few as runs and are read here once.
    """
    earliest = starts.agg(F.min("first_dt")).first()[0]
    own = F.broadcast(starts.filter(F.col("first_dt") >= F.lit(earliest)).select(F.col("run").alias("_run"), "first_dt"))
    rows = stored.filter(F.col("dt") >= F.lit(earliest).cast("date"))
    return rows.join(own, (F.col("run") == F.col("_run")) & (F.col("dt") >= F.col("first_dt"))).drop("_run", "first_dt")


def assign_shift_day(df: DataFrame, start_date: str, days: int, ts_col: str = "ts_ms") -> DataFrame:
    """The production day ``dt``: whole shifts since the start, the last day at most."""
    day = F.least(F.lit(days - 1).cast("long"), div(F.col(ts_col), SHIFT_MS))
    return df.withColumn("dt", F.date_add(F.lit(start_date).cast("date"), day.cast("int")))


#: Samples of a fitted bucket, as a share of the station's fullest one.
FITTED_SHARE = 0.2


def fitted_buckets(curve: DataFrame, share: float = FITTED_SHARE) -> DataFrame:
    """Age buckets with at least ``share`` of the samples of the station's fullest one."""
    fullest = F.max("n").over(Window.partitionBy("station"))
    return curve.withColumn("fullest", fullest).filter(F.col("n") >= share * F.col("fullest")).drop("fullest")
