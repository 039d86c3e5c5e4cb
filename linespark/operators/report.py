"""Checks of results: against the truth of a run, and of two outputs against each other."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CHECKED = ["oee", "availability", "performance", "quality", "utilisation"]


def validate_kpis(mined: DataFrame, truth: DataFrame, columns: list[str] | None = None, tolerance: float = 5e-4) -> DataFrame:
    """(station, metric, mined, truth, matches) for all metrics that both have."""
    names = columns or [c for c in CHECKED if c in mined.columns and c in truth.columns]
    long = lambda df, name: df.select("station", *(F.col(c).cast("double").alias(c) for c in names)).unpivot(["station"], names, "metric", name)
    both = long(mined, "mined").join(long(truth, "truth"), ["station", "metric"])
    return both.withColumn("matches", F.abs(F.col("mined") - F.col("truth")) < tolerance)


def diff_outputs(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows that one output has more often than the other, with ``side`` A or B; none if both are the same multiset."""
    n, nth = "n", "nth"
    while n in a.columns or nth in a.columns:
        n, nth = n + "_", nth + "_"
    both = a.withColumn(n, F.lit(1)).unionByName(b.withColumn(n, F.lit(-1)))
    left = both.groupBy(*(F.col(f"`{c}`") for c in a.columns)).agg(F.sum(n).alias(n)).filter(F.col(n) != 0)
    left = left.withColumn("side", F.when(F.col(n) > 0, "A").otherwise("B"))
    return left.withColumn(nth, F.explode(F.sequence(F.lit(1).cast("long"), F.abs(n)))).drop(n, nth)


#: Buckets of a fingerprint; of each there is one row, whatever the outputs' size.
BUCKETS = 1024


def _row_hash(columns: list[str], seed: int) -> Column:
    """A hash of a row; nulls count by their column."""
    own = [F.col(f"`{c}`") for c in columns]
    return F.xxhash64(F.lit(seed), *(x for c in own for x in (c.isNull(), c)))


def fingerprints(df: DataFrame, columns: list[str] | None = None, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, n, sum_a, sum_b): of the rows dealt out by a hash, their number and order-free sums of two further hashes.

    Fingerprints of parts of an output add up to that of the whole (``merge_fingerprints``), so those of stored days need no rescan.
    """
    columns = columns or df.columns
    sums = (F.sum(_row_hash(columns, i).cast("decimal(38,0)")).alias(name) for i, name in ((1, "sum_a"), (2, "sum_b")))
    return df.groupBy(F.pmod(_row_hash(columns, 0), F.lit(buckets)).alias("bucket")).agg(F.count("*").alias("n"), *sums)


def merge_fingerprints(parts: DataFrame) -> DataFrame:
    return parts.groupBy("bucket").agg(F.sum("n").alias("n"), *(F.sum(c).cast("decimal(38,0)").alias(c) for c in ("sum_a", "sum_b")))


def differing_buckets(a: DataFrame, b: DataFrame) -> DataFrame:
    """(bucket): where two fingerprints differ; equal ones hide a difference with a chance of about 2 ** -64 only."""
    figures = ["n", "sum_a", "sum_b"]
    both = a.withColumn("side", F.lit(1)).unionByName(b.withColumn("side", F.lit(-1)))
    off = both.groupBy("bucket").agg(*(F.sum(F.col(c) * F.col("side")).alias(c) for c in figures))
    return off.filter(" or ".join(f"{c} <> 0" for c in figures)).select("bucket")


def diff_by_fingerprints(a: DataFrame, b: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """``diff_outputs``, in which only rows of buckets whose fingerprints differ are shuffled; of equal outputs none are.

    The buckets that differ are ``buckets`` rows at most and are broadcast. Columns that can't be hashed (maps) are refused by Spark.
    """
    columns = a.columns
    name = "bucket"
    while name in columns:
        name += "_"
    wanted = F.broadcast(differing_buckets(fingerprints(a, columns, buckets), fingerprints(b, columns, buckets)).withColumnRenamed("bucket", name))
    some = lambda df: df.withColumn(name, F.pmod(_row_hash(columns, 0), F.lit(buckets))).join(wanted, name, "left_semi").drop(name)
    return diff_outputs(some(a), some(b))
