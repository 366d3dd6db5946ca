"""From raw observations to equations: filters with reasons, moving frames, unpivoting."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import air, wind


@dataclass(frozen=True)
class Box:
    """A domain; both ends belong to it."""

    x: tuple[float, float]
    y: tuple[float, float]
    z: tuple[float, float]

    def holds(self, x: Column, y: Column, z: Column) -> Column:
        return x.between(*self.x) & y.between(*self.y) & z.between(*self.z)


def reject_reason(second: Column, start: int, end: int, x: Column, y: Column, z: Column, box: Box) -> Column:
    """Why a row is left out, or NULL: outside [start, end), no position, outside the box."""
    return (
        F.when(~((second >= start) & (second < end)), "time")
        .when(x.isNull() | y.isNull() | z.isNull(), "position")
        .when(~box.holds(x, y, z), "domain")
    )


def in_frame(rows: DataFrame, frames: DataFrame, key: str, columns: tuple[str, ...] = ("fx", "fy", "fu", "fv")) -> DataFrame:
    """Joins each row with the frame of its time; rows without a frame go.

    Frames are one row for each time step; Spark broadcasts them where their
    size allows and sorts both sides where not.
    """
    return rows.join(frames.select(key, *columns), key)


def equations(rows: DataFrame, errors: dict[str, float], keep: tuple[str, ...]) -> DataFrame:
    """One row for each measured variable: its number, value and inverse error.

    rows have u, v, w, temperature, ratio, density (moist) and dry, with the
    reference values t_ref, q_ref and dry_ref; a NULL measures nothing.
    """
    c = F.col
    values = [
        (0, c("density") * c("u"), errors["wind"]),
        (1, c("density") * c("v"), errors["wind"]),
        (2, c("density") * c("w"), errors["w"]),
        (3, c("temperature") - c("t_ref"), errors["temperature"]),
        (4, air.widen(c("ratio")) - c("q_ref"), errors["ratio"]),
        (5, (c("dry") - c("dry_ref")) * 100, errors["density"]),
    ]
    each = F.array(*[F.struct(F.lit(k).alias("variable"), v.alias("value"), F.lit(1.0 / e).alias("inverse_error")) for k, v, e in values])
    told = rows.select(*keep, F.explode(each).alias("e")).select(*keep, "e.*")
    return told.where("value IS NOT NULL")


def rotated(u: Column, v: Column, x: Column, y: Column, frame_u: Column, frame_v: Column) -> tuple[Column, Column]:
    """Radial and tangential momentum direction relative to a moving center."""
    return wind.around(u - frame_u, v - frame_v, x, y)
