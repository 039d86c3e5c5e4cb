"""Policies (nested JSON by station) and result files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import POLICY, POLICY_FIELDS


def missing_stations(policy: DataFrame, stations: DataFrame) -> DataFrame:
    """Stations that the policy lacks."""
    return stations.select("station").distinct().join(policy, "station", "left_anti")


def read_policy(spark: SparkSession, path: str, stations: DataFrame | None = None) -> DataFrame:
    """One row for each station of a policy file; raises if one of ``stations`` is missing."""
    raw = spark.read.option("multiLine", True).schema(POLICY).json(path)
    policy = raw.select("policy_id", "provenance", F.explode("stations").alias("station", "s")).select("policy_id", "provenance", "station", "s.*")
    if stations is not None and (lost := sorted(r[0] for r in missing_stations(policy, stations).limit(20).collect())):
        raise ValueError(f"the policy has no entry for {', '.join(lost)}")
    return policy


def policy_json(policy: DataFrame) -> DataFrame:
    """(policy_id, json): one nested document for each policy, stations in order."""
    entry = F.struct("station", F.struct(*POLICY_FIELDS).alias("s"))
    stations = F.map_from_entries(F.sort_array(F.collect_list(entry)))
    found = policy.groupBy("policy_id").agg(F.first("provenance", ignorenulls=True).alias("provenance"), stations.alias("stations"))
    return found.select("policy_id", F.to_json(F.struct("policy_id", "provenance", "stations")).alias("json"))


def write_policy(policy: DataFrame, path: str) -> None:
    """Write each policy as one JSON document in a file of its own line."""
    policy_json(policy).select(F.col("json").alias("value")).write.mode("overwrite").text(path)
