"""Structured Streaming: windows over events, sessions, duplicates, new files only."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def event_stream(spark: SparkSession, path: str, schema, late: str = "2 hours", files: int = 100) -> DataFrame:
    """Events of Parquet files as they arrive, with a watermark on ``ts``."""
    raw = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)
    return raw.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)


def tumbling(events: DataFrame, width: str = "1 day", slide: str | None = None) -> DataFrame:
    """Counts and sums of each window and event type; with ``slide`` the windows overlap. Batch and stream alike."""
    w = F.window("ts", width, slide) if slide else F.window("ts", width)
    g = events.groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return g.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "6 hours") -> DataFrame:
    """Runs of a user's events with gaps below ``gap``."""
    g = events.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n"), F.min("ts").alias("first"), F.max("ts").alias("last"))
    return g.select("user_id", "first", "last", "n")


def without_repeats(events: DataFrame, keys: list[str]) -> DataFrame:
    """Each event once; state is kept only within the watermark."""
    return events.dropDuplicatesWithinWatermark(keys) if events.isStreaming else events.dropDuplicates(keys)


def incremental(spark: SparkSession, source: str, schema, target: str, checkpoint: str, transform=lambda df: df):
    """Files not processed before, each exactly once, into ``target``; returns when all are done."""
    stream = transform(spark.readStream.schema(schema).parquet(source))
    q = stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).start(path=target, format="parquet", outputMode="append")
    q.awaitTermination()
    return spark.read.parquet(target)
