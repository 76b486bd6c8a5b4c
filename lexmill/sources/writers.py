"""Sinks: Spark's committers make each of them atomic."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def streams(df: DataFrame, path: str) -> None:
    """Encoded streams by language and split; a rerun replaces the partitions that it has."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("lang", "split").parquet(path)


def vocabulary(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def text_split(df: DataFrame, path: str) -> None:
    df.select("text").write.mode("overwrite").text(path)


def csv_table(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def tsv_table(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).option("sep", "\t").csv(path)


def json_log(df: DataFrame, path: str) -> None:
    """Appends rows with the time of writing."""
    df.withColumn("logged_at", F.current_timestamp()).write.mode("append").json(path)


def markdown(df: DataFrame, limit: int = 100) -> str:
    """A small result as a Markdown table; the limit is the report's length."""
    rows = df.limit(limit).collect()
    return "\n".join(["| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns), *("| " + " | ".join(str(v) for v in r) + " |" for r in rows)])
