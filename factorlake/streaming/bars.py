"""Daily bars from a stream of events. The reference inventory has no streams; this is an addition."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_events(spark: SparkSession, path: str, schema) -> DataFrame:
    """A folder of event files as a stream."""
    return spark.readStream.schema(schema).parquet(path)


def daily_bars(events: DataFrame, lateness: str = "1 day", width: str = "1 day") -> DataFrame:
    """(window, event_type, open, high, low, close, n): bars of event time; events later than `lateness` are dropped
    once their window is closed. The same expression serves batches and streams."""
    stamped = events.withWatermark("ts", lateness) if events.isStreaming else events
    turn = F.struct("ts", "event_id")
    return stamped.groupBy(F.window("ts", width).alias("w"), "event_type").agg(
        F.min_by("value", turn).alias("open"), F.max("value").alias("high"), F.min("value").alias("low"), F.max_by("value", turn).alias("close"), F.count("*").alias("n")
    ).select(F.col("w.start").cast("date").alias("trade_date"), "event_type", "open", "high", "low", "close", "n")


def write_bars(bars: DataFrame, folder: str, checkpoint: str):
    """Closed bars appended to Parquet as the watermark passes them; restarts go on from the checkpoint."""
    return bars.writeStream.outputMode("append").format("parquet").option("path", folder).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
