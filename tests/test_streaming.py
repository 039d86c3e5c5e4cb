"""The live check on a stream gives what the batch form gives."""

from pyspark.sql import functions as F

from linespark.operators import limits
from linespark.plans import adapters
from linespark.schemas import TELEMETRY
from linespark.streaming import live

SF = "/root/testdata/sf0.001"


def test_stream_matches_batch(spark, tmp_path):
    telemetry = adapters.telemetry(spark, SF)
    telemetry.orderBy("ts_ms").coalesce(1).write.parquet(str(tmp_path / "in"))
    narrow = limits.control_limits(telemetry, None, 1.0)
    narrow.write.parquet(str(tmp_path / "limits"))
    static = spark.read.parquet(str(tmp_path / "limits"))
    # A last sample far in the future closes all windows before it.
    spark.createDataFrame([(4_000_000_000_000, "S01", "torque", 0.0)], TELEMETRY).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(TELEMETRY).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = live.breach_stream(stream, static).writeStream.format("memory").queryName("breaches").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination(240)
    key = lambda df: sorted(map(tuple, df.select("station", "signal", "window_start_ms", "samples", "breaches").collect()))
    assert key(spark.table("breaches")) == key(live.breach_counts(telemetry, static))
    assert spark.table("breaches").agg(F.sum("breaches")).first()[0] > 0
