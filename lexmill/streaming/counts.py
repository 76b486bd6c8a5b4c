"""Structured Streaming versions of corpus counts. These add to what the batch queries do."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def document_stream(spark: SparkSession, path: str, schema) -> DataFrame:
    return spark.readStream.schema(schema).parquet(path)


def running_counts(docs: DataFrame) -> DataFrame:
    """Documents and characters by language, in complete or update mode."""
    return docs.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).alias("chars"))


def windowed_events(events: DataFrame, late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Events by type and window; state is dropped behind the watermark."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
