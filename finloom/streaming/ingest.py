"""Incremental ingest with Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from finloom.operators.predicates import compile_where
from finloom.schemas import CHUNK_SCHEMA


def chunk_stream(spark: SparkSession, path: str, late: str = "7 days", where: dict | None = None, files_per_batch: int = 100) -> DataFrame:
    """New chunk files below ``path``, each chunk once within ``late`` of its ``chunked_at``."""
    raw = spark.readStream.schema(CHUNK_SCHEMA).option("maxFilesPerTrigger", files_per_batch).option("recursiveFileLookup", "true").json(path)
    rows = raw.withColumn("at", F.to_timestamp("chunked_at")).filter(F.col("at").isNotNull() & compile_where(where))
    return rows.withWatermark("at", late).dropDuplicatesWithinWatermark(["chunk_id"])


def append_to(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Appends what is there now to a Parquet table, exactly once, and ends."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def _timed(events: DataFrame, time: str, late: str) -> DataFrame:
    """Event time as ``_at``; a watermark needs a timestamp with zone, a table keeps its own type."""
    if not events.isStreaming:
        return events.withColumn("_at", F.col(time))
    return events.withColumn("_at", F.col(time).cast("timestamp")).withWatermark("_at", late)


def windowed_counts(events: DataFrame, time: str, width: str, late: str, *keys: str) -> DataFrame:
    """Counts and sums of ``value`` in tumbling windows of event time; works on streams and tables alike. Timestamps
    without zone are taken as UTC."""
    rows = _timed(events, time, late)
    return rows.groupBy(F.window("_at", width).alias("w"), *keys).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *keys, "n", "total")


def session_counts(events: DataFrame, time: str, gap: str, late: str, *keys: str) -> DataFrame:
    """Events of a key in sessions that a pause of ``gap`` ends."""
    rows = _timed(events, time, late)
    return rows.groupBy(F.session_window("_at", gap).alias("w"), *keys).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *keys, "n")
