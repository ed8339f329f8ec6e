"""Extension: windowed counts over a stream of events, with a watermark.

The graph engine itself has no streams; this shows its tables fed by one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EVENT_DDL = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def read_events(spark: SparkSession, folder: str, files_per_trigger: int = 8) -> DataFrame:
    return spark.readStream.schema(EVENT_DDL).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def windowed(events: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """window_start, event_type, events, value: rows later than the watermark
    are left out, and state is bounded by it."""
    own = events.withColumn("ts", F.col("ts").cast("timestamp"))
    own = own.withWatermark("ts", late) if own.isStreaming else own
    grouped = own.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("events"), F.sum("value").alias("value"))
    return grouped.select(F.col("w.start").alias("window_start"), "event_type", "events", "value")


def write_windows(windows: DataFrame, folder: str, checkpoint: str):
    """Append finished windows as Parquet; runs until what is there is read."""
    return windows.writeStream.format("parquet").option("path", folder).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
