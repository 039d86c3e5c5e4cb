"""Stored roll-ups: partial figures by day on disk, of which single days are replaced and none else is read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def store_parts(partials: DataFrame, path: str, by: str = "dt") -> None:
    """Store partial figures in a folder for each value of ``by``; values that ``partials`` has are replaced, all others stay.

    Storing the same parts again changes nothing, so a job that failed can be run again.
    """
    partials.repartition(by).write.partitionBy(by).mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(path)


def read_parts(spark: SparkSession, path: str) -> DataFrame:
    """The stored parts; a filter on the folder's column leaves other folders unread."""
    return spark.read.parquet(path)
