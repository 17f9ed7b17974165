"""Event streams: tumbling and session windows with watermarks, and incremental runs that take what is new and stop."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType


def read_events(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """Parquet files that appear below ``path`` as a stream."""
    return spark.readStream.schema(schema).parquet(path)


def tumbling(events: DataFrame, width: str = "1 hour", late: str | None = None) -> DataFrame:
    """start, event_type, n, total per window; works on a table and, with ``late``, on a stream."""
    rows = events if late is None else events.withWatermark("ts", late)
    grouped = rows.groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return grouped.select(F.col("window.start").alias("start"), "event_type", "n", "total")


def session(events: DataFrame, gap: str = "30 minutes", late: str | None = None) -> DataFrame:
    """start, end, user_id, n per session of a user."""
    rows = events if late is None else events.withWatermark("ts", late)
    grouped = rows.groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n"))
    return grouped.select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "user_id", "n")


def write_available(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append what is new to a table and stop; the checkpoint remembers what was done."""
    return stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(path)
