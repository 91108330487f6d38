"""Search-log windows: a batch form and the same aggregate over a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tidemark.functions.scalar import mean


def log_windows(log: DataFrame, width: str = "1 day", ts: str = "created_at") -> DataFrame:
    """Searches and mean latency per window and query type; works on batch and streaming frames."""
    return log.groupBy(F.window(ts, width).alias("w"), "query_type").agg(
        F.count(F.lit(1)).alias("searches"), mean("search_time_ms", 4).alias("avg_ms")
    ).select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "query_type", "searches", "avg_ms")


def log_windows_stream(stream: DataFrame, width: str = "1 day", late: str = "1 hour", ts: str = "created_at") -> DataFrame:
    """Rows later than the watermark are dropped; a window comes out once the watermark has passed it."""
    # watermarks need a zoned timestamp
    timed = stream.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)
    return log_windows(timed, width, ts)


def append_log(stream: DataFrame, path: str, checkpoint: str):
    """Append a stream of log rows to a Parquet table, exactly once."""
    return stream.writeStream.format("parquet").option("checkpointLocation", checkpoint).outputMode("append").start(path)
