"""Incremental ingest of interactions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery


def interactions_stream(spark: SparkSession, path: str, schema: str, watermark: str = "1 hour") -> DataFrame:
    """Distinct (user_id, app_id) of a growing folder of Parquet files; state older than the watermark on `ts` goes."""
    rows = spark.readStream.schema(schema).parquet(path)
    return rows.na.drop(subset=["user_id", "app_id"]).withWatermark("ts", watermark).dropDuplicatesWithinWatermark(["user_id", "app_id"])


def start(rows: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    return rows.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
