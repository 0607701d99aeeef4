"""Streaming forms of event operators: deduplication, windows, debounce, change capture."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType


def event_stream(spark: SparkSession, path: str, schema: StructType, per_trigger: int = 1) -> DataFrame:
    """Parquet files of a folder as a stream; ``ts`` becomes a zoned timestamp, as watermarks need one."""
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(path)
    return rows.withColumn("created_at", F.col("ts").cast("timestamp")).drop("ts")


def deduplicated(events: DataFrame, key: str, delay: str = "10 minutes") -> DataFrame:
    """First event of each key within the watermark."""
    return events.withWatermark("created_at", delay).dropDuplicatesWithinWatermark([key])


def windowed_counts(events: DataFrame, width: str = "1 hour", delay: str = "10 minutes") -> DataFrame:
    rows = events.withWatermark("created_at", delay).groupBy(F.window("created_at", width), "event_type")
    return rows.agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), "event_type", "n", "total")


def bursts(events: DataFrame, key: str, gap: str = "2 seconds", delay: str = "10 minutes") -> DataFrame:
    """Debounced bursts by session window."""
    rows = events.withWatermark("created_at", delay).groupBy(F.session_window("created_at", gap), key)
    return rows.agg(F.count(F.lit(1)).alias("n")).select(F.col("session_window.start").alias("first_at"), key, "n")


def run_available(stream: DataFrame, out: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Process what is there, then stop; exactly once by the file sink's log."""
    query = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def upsert_batches(stream: DataFrame, apply, checkpoint: str) -> StreamingQuery:
    """Micro-batches to ``apply(batch, epoch)``, for sinks that merge by key."""
    query = stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query
