"""Utilisation per station and the longest run of blocked cycles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import ratio
from ..schemas import CYCLE_ORDER
from .oee import merged_columns, oee_of_totals, partial_columns

#: A week: some ten thousand cycles of a station.
CHUNK_MS = 7 * 24 * 3600 * 1000
#: Before the names of OEE's figures in chunks.
OEE = "oee_"


def run_chunks(part_events: DataFrame, chunk_ms: int = CHUNK_MS, by: list[str] | None = None, instead: Column | None = None, with_oee: bool = False) -> DataFrame:
    """One row for each (station, chunk): its length, first, last and best run of blocked cycles, and its sums.

    Chunks can be stored and further ones added: ``bottleneck_of_chunks`` needs nothing else. ``by`` names further keys;
    where ``instead`` isn't null it is the chunk. ``with_oee`` adds the additive figures of OEE, for both in one pass.
    """
    keys = [*(by or []), "station", "chunk"]
    sums = ["cycle_ms", "blocked_ms", "starved_ms"]
    chunk = F.floor(F.col("ts_end_ms") / F.lit(chunk_ms)).cast("long")
    further = ["down_ms", "status"] if with_oee else []
    rows = part_events.select(*keys[:-1], *CYCLE_ORDER, *further, (chunk if instead is None else F.coalesce(instead, chunk)).alias("chunk"))
    order = Window.partitionBy(*keys).orderBy(*CYCLE_ORDER).rowsBetween(Window.unboundedPreceding, 0)
    free = F.when(F.col("blocked_ms") > 0, 0).otherwise(1)
    runs = rows.withColumn("island", F.sum(free).over(order)).groupBy(*keys, "island").agg(F.count("*").alias("rows"), F.count(F.when(F.col("blocked_ms") > 0, 1)).alias("n"), *(F.sum(c).alias(c) for c in sums), *(partial_columns(F.col("cycle_ms") > 0, OEE) if with_oee else []))
    return runs.groupBy(*keys).agg(
        F.sum("rows").alias("len"),
        F.coalesce(F.max(F.when(F.col("island") == 0, F.col("n"))), F.lit(0).cast("long")).alias("prefix"),
        F.max_by("n", "island").alias("suffix"),
        F.max("n").alias("best"),
        *(F.sum(c).alias(c) for c in sums),
        *(merged_columns(OEE) if with_oee else []),
    )


def _longest() -> Column:
    """The longest run of a station, stitched from its chunks in order."""
    zero = F.lit(0).cast("long")
    start = F.struct(zero.alias("len"), zero.alias("prefix"), zero.alias("suffix"), zero.alias("best"))
    parts = F.transform(F.sort_array(F.collect_list(F.struct("chunk", "len", "prefix", "suffix", "best"))), lambda p: F.struct(p["len"].alias("len"), p["prefix"].alias("prefix"), p["suffix"].alias("suffix"), p["best"].alias("best")))

    def stitch(a, b):
        return F.struct(
            (a["len"] + b["len"]).alias("len"),
            F.when(a["prefix"] == a["len"], a["len"] + b["prefix"]).otherwise(a["prefix"]).alias("prefix"),
            F.when(b["suffix"] == b["len"], a["suffix"] + b["len"]).otherwise(b["suffix"]).alias("suffix"),
            F.greatest(a["best"], b["best"], a["suffix"] + b["prefix"]).alias("best"),
        )

    return F.aggregate(parts, start, stitch, lambda a: a["best"]).alias("longest_blocked_run")


def longest_blocked_run(part_events: DataFrame, chunk_ms: int = CHUNK_MS) -> DataFrame:
    """(station, longest_blocked_run) by gaps and islands in chunks of time that are stitched together.

    A chunk comes down to its length, first run, last run and best run, so a station with very
    many cycles is as many tasks as it has chunks; only four numbers a chunk meet in one.
    """
    return longest_of_chunks(run_chunks(part_events, chunk_ms))


#: The name under which callers ask for the form in chunks; both are that form.
longest_blocked_run_chunked = longest_blocked_run


def longest_of_chunks(chunks: DataFrame) -> DataFrame:
    """(station, longest_blocked_run) from the chunks of a station's whole time."""
    return chunks.groupBy("station").agg(_longest())


def bottleneck(part_events: DataFrame, chunk_ms: int = CHUNK_MS) -> DataFrame:
    """Cycles, utilisation, idle, blocked and starved time, mean cycle and longest blocked run of each station, in one pass."""
    return bottleneck_of_chunks(run_chunks(part_events, chunk_ms))


def _totals(chunks: DataFrame, *further: Column) -> DataFrame:
    return chunks.groupBy("station").agg(F.sum("len").alias("cycles"), F.sum("cycle_ms").alias("run_ms"), F.sum("blocked_ms").alias("blocked_ms"), F.sum("starved_ms").alias("starved_ms"), _longest(), *further)


def _figures() -> list[Column | str]:
    idle = F.col("blocked_ms") + F.col("starved_ms")
    return [
        "station", "cycles", ratio(F.col("run_ms"), F.col("run_ms") + idle).alias("utilisation"), (idle / 1000.0).alias("idle_s"), (F.col("blocked_ms") / 1000.0).alias("blocked_s"),
        (F.col("starved_ms") / 1000.0).alias("starved_s"), (F.col("run_ms") / 1000.0 / F.col("cycles")).alias("mean_cycle_s"), "longest_blocked_run",
    ]


def bottleneck_of_chunks(chunks: DataFrame) -> DataFrame:
    """``bottleneck`` from the chunks of a station's whole time."""
    return _totals(chunks).select(*_figures())


def oee_and_bottleneck(part_events: DataFrame, ideal: DataFrame | None = None, chunk_ms: int = CHUNK_MS) -> DataFrame:
    """(station, oee, bottleneck): the figures of ``oee`` (null without a counted cycle) and of ``bottleneck`` as structs, by one pass over the cycles."""
    totals = _totals(run_chunks(part_events, chunk_ms, with_oee=True), *merged_columns(OEE))
    own = (F.col(c).alias(c.removeprefix(OEE)) for c in totals.columns if c.startswith(OEE))
    rated = oee_of_totals(totals.select("station", *own, F.struct(*_figures()[1:]).alias("bottleneck")), ideal, "bottleneck")
    return rated.select("station", F.when(F.col("parts") > 0, F.struct(*rated.columns[1:-1])).alias("oee"), "bottleneck")


def find_constraint(table: DataFrame) -> DataFrame:
    """The station of highest utilisation as it's reported (to four digits), the first by name if several are."""
    return table.orderBy(F.round("utilisation", 4).desc(), "station").limit(1).select("station", "utilisation")


def time_split(table: DataFrame) -> DataFrame:
    """(station, state, share, hours): busy, blocked and starved time in long form."""
    parts = table.select("station", (F.col("cycles") * F.col("mean_cycle_s")).alias("busy"), F.col("blocked_s").alias("blocked"), F.col("starved_s").alias("starved"))
    total = F.nullif(F.col("busy") + F.col("blocked") + F.col("starved"), F.lit(0.0))
    long = parts.withColumn("total", total).unpivot(["station", "total"], ["busy", "blocked", "starved"], "state", "seconds")
    return long.select("station", "state", (F.col("seconds") / F.col("total")).alias("share"), (F.col("seconds") / 3600.0).alias("hours"))


def pivot_time_split(split: DataFrame) -> DataFrame:
    """(station, busy, blocked, starved): shares in wide form."""
    return split.groupBy("station").pivot("state", ["busy", "blocked", "starved"]).agg(F.first("share"))


def ordered_shares(split: DataFrame) -> DataFrame:
    """Shares in order of station and state."""
    return split.orderBy("station", "state")
