"""Work on columns of air: levels of constant pressure, and smoothing splines with a cutoff wavelength."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .lines import _basis

#: The level of the rows that stand for the surface.
SURFACE = 2013.0


def pressure_levels(rows: DataFrame, key: str, z: str, pressure: str, fields: list[str], step: float) -> DataFrame:
    """key, level, height and the fields where each column's pressure is a multiple of step; and the lowest row of the column as the surface.

    Each layer between two neighbouring rows of a column holds the levels of
    its own range of pressures, which follow from its ends: no table of levels
    is joined, and a column is never one row.  Height and fields are linear in
    the logarithm of pressure; layers in which it does not fall give nothing.
    """
    up = Window.partitionBy(key).orderBy(z)  # the levels of one column
    ahead = {f"__{c}": F.lead(c).over(up) for c in (z, pressure, *fields)}
    layers = rows.select(key, z, pressure, *fields, F.row_number().over(up).alias("__turn"), *[c.alias(n) for n, c in ahead.items()])
    low, high = F.col(pressure), F.col(f"__{pressure}")
    first, last = F.floor(high / step) + 1, F.floor(low / step)
    between = layers.where(high < low).where(first <= last).withColumn("level", F.explode(F.sequence(first, last))).withColumn("level", F.col("level") * F.lit(float(step)))
    share = F.log(low / F.col("level")) / F.log(low / high)
    inside = between.select(key, "level", (F.col(z) + share * (F.col(f"__{z}") - F.col(z))).alias("height"), *[(F.col(f) + share * (F.col(f"__{f}") - F.col(f))).alias(f) for f in fields])
    surface = layers.where("__turn = 1").select(key, F.lit(SURFACE).alias("level"), F.col(z).cast("double").alias("height"), *[F.col(f).cast("double").alias(f) for f in fields])
    return inside.unionByName(surface)


def smoothing_matrix(at: np.ndarray, low: float, step: float, nodes: int, cutoff: float, to: np.ndarray | None = None) -> np.ndarray:
    """What takes values at places to the spline that is near them without waves shorter than the cutoff, at places again.

    Least squares with a weight on third derivatives that halves a wave of the
    cutoff's length; nodes beyond all places follow from that weight alone.
    """
    def spread(x: np.ndarray, derivative: int) -> np.ndarray:
        return _basis((x[:, None] - low) / step - np.arange(nodes)[None, :], derivative)

    quad = (np.arange(nodes - 1)[:, None] + 0.5 + 0.5 * np.sqrt(1 / 3) * np.array([-1, 1])).ravel() * step + low
    h, q = spread(at, 0), spread(quad, 3)
    weight = (cutoff / (2 * np.pi * step)) ** 6 / 2
    whole = h.T @ h + weight * q.T @ q + 1e-9 * np.eye(nodes)
    return spread(at if to is None else to, 0) @ np.linalg.solve(whole, h.T)


def smoothed_columns(rows: DataFrame, key: str, z: str, value: str, low: float, step: float, nodes: int, cutoff: float) -> DataFrame:
    """key, z, value of every row of a column whose value is not NULL, by a smoothing spline; a column is a group of bounded size.

    Columns with the same places share one solve, whatever their values.
    """
    each = rows.where(F.col(value).isNotNull()).groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col(z).cast("double").alias("z"), F.col(value).cast("double").alias("v")))).alias("c"))

    def work(columns: pd.Series) -> pd.Series:
        known: dict[bytes, np.ndarray] = {}
        out = []
        for c in columns:
            at, v = np.array([x["z"] for x in c]), np.array([x["v"] for x in c])
            m = known.get(at.tobytes())
            if m is None:
                m = known[at.tobytes()] = smoothing_matrix(at, low, step, nodes, cutoff)
            out.append(m @ v)
        return pd.Series(out)

    told = each.withColumn("s", F.pandas_udf(work, "array<double>")("c"))
    return told.select(key, F.inline(F.arrays_zip(F.transform("c", lambda x: x["z"]).alias(z), F.col("s").alias(value))))
