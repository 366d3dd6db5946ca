"""Observation files as they arrive: rows with event time, and counts by window that late rows still reach."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.text import read_text


def followed(spark: SparkSession, path: str, kind: str, late: str = "1 hour") -> DataFrame:
    """A stream of the rows of files that arrive at path, with their time and a watermark."""
    return read_text(spark, path, kind, stream=True).withColumn("time", F.timestamp_seconds("second")).withWatermark("time", late)


def counted(rows: DataFrame, window: str = "1 hour") -> DataFrame:
    """start and n_rows of each window of a stream of rows with time; a window is told once the watermark has passed it."""
    return rows.groupBy(F.window("time", window).alias("w")).agg(F.count("*").alias("n_rows")).select(F.col("w.start").alias("start"), "n_rows")
