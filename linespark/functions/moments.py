"""Moments and co-moments of parts of the rows, which merge exactly without the rows (Chan, Golub and LeVeque)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def moments(value: Column) -> list[Column]:
    """n, mean and m2, the sum of squared deviations from the part's own mean."""
    return [F.count("*").alias("n"), F.avg(value).alias("mean"), (F.var_pop(value) * F.count("*")).alias("m2")]


def merge_moments(partials: DataFrame, keys: list[str], *further: Column) -> DataFrame:
    """(keys, n, mean, m2, further) from parts of any split.

    Deviations are taken from the merged mean, never as a difference of large squares.
    """
    whole = Window.partitionBy(*keys)
    overall = F.sum(F.col("mean") * F.col("n")).over(whole) / F.sum("n").over(whole)
    parts = partials.withColumn("_overall", overall)
    off = F.col("mean") - F.col("_overall")
    return parts.groupBy(*keys).agg(F.sum("n").alias("n"), F.first("_overall").alias("mean"), F.sum(F.col("m2") + F.col("n") * off * off).alias("m2"), *further)


def sd_of(n: str = "n", m2: str = "m2") -> Column:
    """Standard deviation with n - 1, and 0.0 for a single value."""
    return F.when(F.col(n) > 1, F.sqrt(F.col(m2) / (F.col(n) - 1))).otherwise(0.0)


def comoments(x: Column, y: Column) -> list[Column]:
    """n, both means, the squared deviations of x and the products of both deviations."""
    n = F.count("*")
    return [n.alias("n"), F.avg(x).alias("mean_x"), F.avg(y).alias("mean_y"), (F.var_pop(x) * n).alias("cxx"), (F.covar_pop(x, y) * n).alias("cxy")]


def merge_comoments(partials: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, n, mean_x, mean_y, cxx, cxy) from parts of any split."""
    whole = Window.partitionBy(*keys)
    total = F.sum("n").over(whole)
    overall = {f"_{c}": F.sum(F.col(f"mean_{c}") * F.col("n")).over(whole) / total for c in "xy"}
    off_x, off_y = (F.col(f"mean_{c}") - F.col(f"_{c}") for c in "xy")
    sums = [F.sum("n").alias("n"), *(F.first(f"_{c}").alias(f"mean_{c}") for c in "xy")]
    sums += [F.sum(F.col("cxx") + F.col("n") * off_x * off_x).alias("cxx"), F.sum(F.col("cxy") + F.col("n") * off_x * off_y).alias("cxy")]
    return partials.withColumns(overall).groupBy(*keys).agg(*sums)
