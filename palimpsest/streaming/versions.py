"""Streaming ingest: version rows appended as they arrive, sessions closed as they fall silent."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType


def version_stream(spark: SparkSession, folder: str, schema: StructType) -> DataFrame:
    """New Parquet files of a folder as a stream of version rows."""
    return spark.readStream.schema(schema).parquet(folder)


def deduplicated(versions: DataFrame, keys: list[str], delay: str = "1 day") -> DataFrame:
    """Each delivered version once: rows equal in key, time and flag that arrive within ``delay`` of event time are dropped.

    The state holds keys of the watermark's span only. Rows without
    ``ingested_at`` pass by the watermark and are dropped as too late.
    """
    timed = versions.withColumn("_at", F.col("ingested_at").cast("timestamp")).withWatermark("_at", delay)
    return timed.dropDuplicatesWithinWatermark([*keys, "valid_from", "asserted"]).drop("_at")


def append(versions: DataFrame, table: str, checkpoint: str) -> StreamingQuery:
    """Append the stream to a Parquet table exactly once, with all that is there now, then stop."""
    return versions.writeStream.format("parquet").option("path", table).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def session_activity(events: DataFrame, key: str, gap: str = "30 minutes", delay: str = "1 hour") -> DataFrame:
    """(key, session, n_events) of sessions that ended: no event for ``gap``; later events than ``delay`` are dropped."""
    timed = events.withColumn("_at", F.col("ts").cast("timestamp")).withWatermark("_at", delay)
    return timed.groupBy(key, F.session_window("_at", gap).alias("session")).agg(F.count("*").alias("n_events"))
