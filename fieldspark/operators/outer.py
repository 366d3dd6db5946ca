"""Outer iterations: the background is adjusted to its own samples, then analysed against the observations some times over.

Every step's state is a folder of its own, marked when its job has finished.
A run that is given the folder of an earlier one goes on behind the last
marked step, whether it was stopped between steps or within one.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .minimise import SQUARE, Cost, Loss, truncated_newton
from .solve import SparseOperator, settled


@dataclass(frozen=True)
class Step:
    """What one step solves: an operator (row, col, h), what it should give (row, d, weight), and its settings."""

    h: DataFrame
    d: DataFrame
    loss: Loss = SQUARE
    tolerance: float = 1e-4
    keep: float = 1.0  # how much of the state so far is the background of this step


def _folder(path: str, k: int) -> str:
    return f"{path.rstrip('/')}/step-{k}"


def finished(spark: SparkSession, path: str) -> int:
    """How many steps of a run at path are there, marked, without a gap."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    files = hadoop(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    k = 0
    while files.exists(hadoop(f"{_folder(path, k)}/_SUCCESS")):
        k += 1
    return k


def solved(step: Step, before: DataFrame | None) -> DataFrame:
    """(col, x, dx): the state before, and the increment of least cost for what it leaves unexplained."""
    with SparseOperator(step.h) as op:
        d = step.d.select("row", "d", "weight")
        base = op.columns().withColumn("x", F.lit(0.0))
        if before is not None:
            base = base.select("col").join(before.select("col", (step.keep * F.col("x")).alias("x")), "col", "full").select("col", F.coalesce("x", F.lit(0.0)).alias("x"))
            seen = op.product(base, "x")
            d = d.join(seen, "row", "left").select("row", (F.col("d") - F.coalesce("v", F.lit(0.0))).alias("d"), "weight")
        point = truncated_newton(Cost(op, d, step.loss), tolerance=step.tolerance).point
        found = base.join(point.state.select("col", F.col("x").alias("dx")), "col", "left").select("col", "x", F.coalesce("dx", F.lit(0.0)).alias("dx"))
        return settled(found.select("col", (F.col("x") + F.col("dx")).alias("x"), "dx"))


def run(spark: SparkSession, path: str, steps: list[Callable[[], Step]]) -> DataFrame:
    """The state (col, x, dx) after the last step; each is written below path, and what an earlier run has finished is read."""
    done = finished(spark, path)
    for k in range(done, len(steps)):
        before = spark.read.parquet(_folder(path, k - 1)) if k else None
        solved(steps[k](), before).write.mode("overwrite").parquet(_folder(path, k))
    return spark.read.parquet(_folder(path, len(steps) - 1))
