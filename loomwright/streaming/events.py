"""Incremental versions of the aggregates over events: watermarked windows, exactly-once deduplication, alerts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def event_stream(spark: SparkSession, path: str, files_a_trigger: int = 1) -> DataFrame:
    """A stream of the Parquet files that arrive in a folder, with the schema of those there."""
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_trigger).parquet(path).withColumn("ts", F.col("ts").cast("timestamp"))


def window_counts(events: DataFrame, lateness: str = "1 hour", size: str = "1 day") -> DataFrame:
    """Counts and mean values by window and type; state older than the watermark is dropped."""
    found = events.withWatermark("ts", lateness).groupBy(F.window("ts", size), "event_type").agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean_value"))
    return found.select(F.col("window.start").alias("start"), "event_type", "n", "mean_value")


def once(events: DataFrame, lateness: str = "1 hour") -> DataFrame:
    """Each event_id once, while its repetitions arrive within the watermark."""
    return events.withWatermark("ts", lateness).dropDuplicatesWithinWatermark(["event_id"])


def alert_stream(events: DataFrame, least: float) -> DataFrame:
    return events.where(F.col("value") >= least).select("event_id", "ts", "event_type", F.when(F.col("value") >= 1.5 * least, "CRITICAL").otherwise("WARNING").alias("severity"))
