"""Sinks: mined text rows, partitioned ingest and result files."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Names and formats of the fields of the mined text rows.
KV_LAYOUTS = {
    "oee": [("parts", "%d"), ("good", "%d"), ("oee", "%.4f"), ("availability", "%.4f"), ("performance", "%.4f"), ("quality", "%.4f"), ("defect_rate", "%.5f"), ("ideal_cycle_s", "%.3f"), ("min_cycle_s", "%.3f"), ("down_s", "%.1f"), ("blocked_s", "%.1f"), ("starved_s", "%.1f")],
    "bottleneck": [("cycles", "%d"), ("utilisation", "%.4f"), ("idle_s", "%.1f"), ("blocked_s", "%.1f"), ("starved_s", "%.1f"), ("mean_cycle_s", "%.3f"), ("longest_blocked_run", "%d")],
    "limits": [("signal", "%s"), ("n", "%d"), ("mean", "%.4f"), ("sd", "%.4f"), ("lcl", "%.4f"), ("ucl", "%.4f"), ("min", "%.4f"), ("max", "%.4f")],
    "degradation": [("age_h", "%.2f"), ("n", "%d"), ("mean", "%.4f"), ("sd", "%.4f")],
}


def _shown(name: str, layout: str) -> Column:
    return F.format_string(f"{name}={layout}", F.col(name).cast("long" if layout == "%d" else "string" if layout == "%s" else "double"))


def to_kv_text(df: DataFrame, kind: str) -> DataFrame:
    """(value): the mined text row of each station for one of the four job kinds."""
    return df.select(F.concat_ws("\t", "station", *(_shown(n, f) for n, f in KV_LAYOUTS[kind])).alias("value"))


def _check_run(run: str) -> None:
    if not re.fullmatch(r"[\w.-]+", run):
        raise ValueError(f"the name of a run has letters, digits, '_', '.' and '-' only: {run!r}")


def ingest_run(df: DataFrame, run: str, path: str) -> None:
    """Store a run below ``run=..`` by day and station; the whole old run is replaced, other runs stay.

    Needs ``dt`` or ``station``; rows are dealt by them first, so each partition gets few files.
    """
    by = [c for c in ("dt", "station") if c in df.columns]
    if not by:
        raise ValueError("a run is stored by dt and station; the table has neither")
    _check_run(run)
    df.repartition(*by).write.partitionBy(*by).mode("overwrite").option("partitionOverwriteMode", "static").parquet(f"{path}/run={run}")


def ingest_days(df: DataFrame, run: str, path: str) -> None:
    """Store whole days of a run: the days that the table has are replaced, all other days and runs stay as they are.

    Stations of a replaced day that the table does not have are removed once the new rows are there.
    """
    _check_run(run)
    if not {"dt", "station"} <= set(df.columns):
        raise ValueError("days of a run are stored by dt and station")
    spark, top = df.sparkSession, f"{path}/run={run}"
    paths = spark._jvm.org.apache.hadoop.fs
    files = paths.Path(top).getFileSystem(spark._jsc.hadoopConfiguration())
    kept = {(str(r[0]), r[1]) for r in df.select(F.col("dt").cast("string"), "station").distinct().collect()}
    df.repartition("dt", "station").write.partitionBy("dt", "station").mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(top)
    names = {(day, f"station={_folder(spark, station)}") for day, station in kept}
    for day in {day for day, _ in kept}:
        for folder in files.listStatus(paths.Path(f"{top}/dt={day}")):
            if folder.isDirectory() and (day, folder.getPath().getName()) not in names:
                files.delete(folder.getPath(), True)


def _folder(spark: SparkSession, value: str | None) -> str:
    """The name that Spark gives the folder of a value."""
    return spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName(value) if value else "__HIVE_DEFAULT_PARTITION__"


def write_summary(df: DataFrame, path: str) -> None:
    """Write run figures or A/B results as JSON lines."""
    df.write.mode("overwrite").json(path)
