"""Connected components of a link table by alternating large-star and small-star steps.

Kiveris et al., "Connected Components in MapReduce and Beyond" (SoCC 2014). Links never
reach the driver; each step is a pair of shuffles, and its result is written to the shared
folder, so a lost executor costs one step at most. Minima and distinct rows are combined
before each shuffle, so a node with very many links does no harm.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import new_path, remove_path


def components(links: DataFrame, max_steps: int = 60) -> DataFrame:
    """(node, component) for each node of ``links(a, b)``; component is the smallest node reached.

    Nodes are longs. Links may repeat, run either way or lead from a node to itself (then they
    are ignored). A node without links has no row. An empty table gives an empty table.
    """
    spark = links.sparkSession

    def put(df: DataFrame) -> tuple[DataFrame, str]:
        path = new_path(spark, "components")
        df.write.parquet(path)
        return spark.read.schema("a long, b long").parquet(path), path

    # Every step keeps links as (a, b) with a > b.
    edges, path = put(links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = None
    for _ in range(max_steps):
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
        large = both.filter("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a")
        small = small.filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select("a", F.col("m").alias("b"))).distinct()
        after, new = put(small)
        state = after.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.countDistinct("a")).first()
        remove_path(spark, path)
        edges, path = after, new
        if state == before:
            break
        before = state
    else:
        raise RuntimeError(f"no fixed point after {max_steps} steps")
    roots = edges.select(F.col("b").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)
