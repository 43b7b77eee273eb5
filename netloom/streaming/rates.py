"""Spike rates over an event stream: windows of event time with a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def event_stream(spark: SparkSession, path: str, schema) -> DataFrame:
    return spark.readStream.schema(schema).parquet(path)


def windowed_rates(events: DataFrame, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """(start, node, n): spikes of each node in tumbling windows; events later than the watermark are left out."""
    stamped = events.select(F.col("user_id").cast("long").alias("node"), F.col("ts").cast("timestamp").alias("ts"))
    return stamped.withWatermark("ts", late).groupBy(F.window("ts", window), "node").agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("start"), "node", "n")
