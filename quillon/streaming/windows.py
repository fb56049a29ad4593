"""Windowed aggregates over event streams, with watermarks for late rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def event_stream(spark: SparkSession, path: str) -> DataFrame:
    """A stream of the Parquet files that the path names, timestamps with a time zone so that watermarks can be set."""
    schema = spark.read.parquet(path).schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 16).parquet(path)
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))


def tumbling(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """w, event_type, n and v (average value) of each window; works on streams and on tables."""
    windows = events.withWatermark("ts", late).groupBy(F.window("ts", width).alias("win"), "event_type")
    return windows.agg(F.count("*").alias("n"), F.avg("value").alias("v")).select(F.col("win.start").alias("w"), "event_type", "n", "v")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """user_id, begin, end and n of each run of a user's events with no longer gap."""
    windows = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("win"), "user_id")
    return windows.agg(F.count("*").alias("n")).select("user_id", F.col("win.start").alias("begin"), F.col("win.end").alias("end"), "n")


def drained(stream: DataFrame, out: str, checkpoint: str) -> DataFrame:
    """Runs a stream over all that is there, into Parquet files (each closed window once), and reads them."""
    query = stream.writeStream.format("parquet").outputMode("append").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(out)
