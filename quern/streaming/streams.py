"""Streams: exact dedup inside a watermark, event windows, sessions, and running metric averages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EVENTS = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def read_events(spark: SparkSession, folder: str, files_per_trigger: int = 1) -> DataFrame:
    """Parquet files of events as they arrive in ``folder``."""
    return spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def drop_repeats(stream: DataFrame, keys: list[str], ts: str = "ts", delay: str = "1 hour") -> DataFrame:
    """Rows whose keys were not seen within the watermark; the state forgets older keys."""
    return stream.withWatermark(ts, delay).dropDuplicatesWithinWatermark(keys)


def tumbling(stream: DataFrame, size: str = "10 minutes", slide: str | None = None, delay: str = "1 hour") -> DataFrame:
    """Count and mean value of each event type in tumbling (or sliding) windows; late rows within the delay count."""
    w = F.window("ts", size, slide) if slide else F.window("ts", size)
    out = stream.withWatermark("ts", delay).groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n"), F.avg("value").alias("mean_value"))
    return out.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "event_type", "n", "mean_value")


def sessions(stream: DataFrame, gap: str = "30 minutes", delay: str = "1 hour") -> DataFrame:
    """Sessions of each user: bursts of events with less than ``gap`` between them."""
    out = stream.withWatermark("ts", delay).groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n"))
    return out.select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")
