"""Lines of text with their file and their number in it, however files are split among tasks.

A file is read in blocks by many tasks.  Each block's lines are counted, the
counts before it summed (one row a block), and a line's number is its turn in
its block beyond that sum: no file, and no group of lines, is held as one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def numbered(spark: SparkSession, path: str) -> DataFrame:
    """file, number (from 0) and value of every line of all files below path, blank ones too."""
    lines = spark.read.option("recursiveFileLookup", True).text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("turn"), "value",
    )
    # turns rise by one within a block, whichever task reads it
    blocks = lines.groupBy("file", "block").agg(F.min("turn").alias("least"), F.count("*").alias("many"))
    before = F.sum("many").over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    blocks = blocks.select("file", "block", (F.coalesce(before, F.lit(0)) - F.col("least")).alias("shift"))
    # a row a block: Spark broadcasts them where they are few enough
    return lines.join(blocks, ["file", "block"]).select("file", (F.col("turn") + F.col("shift")).alias("number"), "value")


def words(line: str = "value") -> Column:
    """A line's fields between blanks."""
    return F.split(F.trim(line), r"\s+")
