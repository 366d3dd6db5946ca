"""Cubic B-splines, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def basis(delta: Column, derivative: int = 0, step: float = 1.0) -> Column:
    """The cubic B-spline or a derivative of it at delta nodes from its center; 0 from two nodes on."""
    z, sign = F.abs(delta), F.when(delta > 0, -1.0).otherwise(1.0)
    far, close = 2.0 - z, F.greatest(1.0 - z, F.lit(0.0))
    value = {
        0: F.pow(far, 3) / 6 - F.pow(close, 3) * 4 / 6,
        1: (far * far / 6 - close * close * 4 / 6) * 3 * sign / step,
        2: (far - 4 * close) / (step * step),
        3: F.when(z > 1, 1.0).when(z < 1, -3.0).otherwise(0.0) * sign / step**3,
    }[derivative]
    return F.when(z < 2, value).otherwise(0.0)
