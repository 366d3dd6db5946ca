"""Grid work as equi-joins: cells within a radius, stencils; nearest neighbours by blocks of the plane."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, StructField, StructType

from ..functions import spline
from . import blocks

#: Distances that a task of nearest works on at once.
CHUNK = 1 << 18


def axis(spark, n: int, name: str, low: float, step: float) -> DataFrame:
    return spark.range(n).select(F.col("id").cast("int").alias(f"i{name}"), (low + step * F.col("id")).alias(name))


def mesh(spark, axes: dict[str, tuple[int, float, float]]) -> DataFrame:
    """Every combination of the axes' nodes: their sizes are a grid's, not the data's."""
    out = None
    for name, (n, low, step) in axes.items():
        one = axis(spark, n, name, low, step)
        out = one if out is None else out.crossJoin(one)
    return out


def cells_within(points: DataFrame, axes: dict[str, tuple[int, float, float]], reach: float) -> DataFrame:
    """points once for each cell whose node lies within the box of reach: the candidates of a range join, by key."""
    for name, (n, low, step) in axes.items():
        first = F.greatest(F.ceil((F.col(name) - reach - low) / step), F.lit(0))
        last = F.least(F.floor((F.col(name) + reach - low) / step), F.lit(n - 1))
        points = points.withColumn(f"i{name}", F.explode(F.when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<bigint>"))))
        points = points.withColumn(f"i{name}", F.col(f"i{name}").cast("int"))
    return points


def weighted_mean(points: DataFrame, axes: dict[str, tuple[int, float, float]], reach: float, value: str, kernel: str = "exponential") -> DataFrame:
    """Of every node with a point nearer than reach: sum of weights, and the weighted mean of value.

    Partial sums before the one shuffle by node.
    """
    near = cells_within(points, axes, reach)
    square = None
    for name, (_, low, step) in axes.items():
        d = F.col(name) - (low + step * F.col(f"i{name}"))
        square = d * d if square is None else square + d * d
    if kernel == "exponential":
        weight = F.exp(-F.log(F.lit(10.0)) * F.col("r2") / reach**2)
    else:
        weight = (reach**2 - F.col("r2")) / (reach**2 + F.col("r2"))
    near = near.withColumn("r2", square).where(F.col("r2") < reach**2).withColumn("weight", weight)
    sums = near.groupBy(*[f"i{n}" for n in axes]).agg(F.sum("weight").alias("weight"), F.sum(F.col("weight") * F.col(value)).alias("total"), F.count("*").alias("n_points"))
    return sums.withColumn("mean", F.col("total") / F.col("weight")).drop("total")


def stencil(points: DataFrame, axes: dict[str, tuple[int, float, float]]) -> DataFrame:
    """points once for each of the four spline nodes around them on each axis, with delta_<axis>; nodes off the grid go."""
    for name, (n, low, step) in axes.items():
        at = (F.col(name) - low) / step
        nodes = F.sequence(F.floor(at) - 1, F.floor(at) + 2)
        points = points.withColumn(f"i{name}", F.explode(nodes)).where(F.col(f"i{name}").between(0, n - 1))
        points = points.withColumn(f"delta_{name}", at - F.col(f"i{name}")).withColumn(f"i{name}", F.col(f"i{name}").cast("int"))
    return points


def dealt(points: DataFrame, *keys: str) -> DataFrame:
    """points dealt over the shuffle partitions before they are multiplied: a table of few bytes is read by one task otherwise, which then makes all that follows."""
    return points.repartition(int(points.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def spline_weights(points: DataFrame, axes: dict[str, tuple[int, float, float]], derivatives: tuple[int, ...] = (0,)) -> DataFrame:
    """points with __<axis>, worked out once a point: its four nodes on the axis as an array of (i, w0, ...), a weight for each of derivatives."""
    made = {}
    for name, (_, low, step) in axes.items():
        at = (F.col(name) - low) / step
        nodes = [F.floor(at) + k for k in (-1, 0, 1, 2)]
        made[f"__{name}"] = F.array(*[F.struct(n.cast("int").alias("i"), *[spline.basis(at - n, o, step).alias(f"w{o}") for o in derivatives]) for n in nodes])
    return points.withColumns(made)


def weighted_stencil(points: DataFrame, axes: dict[str, tuple[int, float, float]]) -> DataFrame:
    """points once for each spline node around them, with i<axis> and the product of the axes' splines as weight; nodes off the grid go."""
    points = spline_weights(points, axes)
    weight = None
    for name, (n, _, _) in axes.items():
        node = f"__{name}"
        points = points.withColumn(node, F.explode(node)).where(F.col(f"{node}.i").between(0, n - 1))
        weight = F.col(f"{node}.w0") if weight is None else weight * F.col(f"{node}.w0")
    return points.withColumns({f"i{name}": F.col(f"__{name}.i") for name in axes} | {"weight": weight}).drop(*[f"__{name}" for name in axes])


def patches(nodes: DataFrame, axes: dict[str, tuple[int, float, float]], fields: list[str]) -> DataFrame:
    """Of each cell c<axis>, ...: the fields at the nodes around it as patch, an array of (p<axis>, ..., field, ...), p the node's place 0 to 3 on the axis.

    A node lies in four cells an axis: the work grows with the grid alone.
    """
    for name in axes:
        nodes = nodes.withColumn(f"p{name}", F.explode(F.array(*[F.lit(k) for k in range(4)]))).withColumn(f"c{name}", F.col(f"i{name}") - F.col(f"p{name}") + 1)
    cell = [f"c{name}" for name in axes]
    return nodes.groupBy(*cell).agg(F.collect_list(F.struct(*[f"p{name}" for name in axes], *fields)).alias("patch"))


def nearest(queries: DataFrame, points: DataFrame, x: str, y: str, k: int, reach: float, query_id: str, point_id: str) -> DataFrame:
    """The k nearest points within reach of each query, ties by id, as a search in a tree of blocks.

    A query meets the points of its own block, which bounds how far the k-th can be, and then those of every block within
    that bound: its work grows with a block's points, not with those within reach. Of points at one place only the k
    least ids can be among the nearest. The distance is the root of the sum of squares: hypot rounds otherwise, and then
    says that equal distances differ.
    """
    placed = F.abs(F.col("__x")) < float("inf")  # false for NaN, NULL for NULL
    placed &= F.abs(F.col("__y")) < float("inf")
    kept = [c for c in points.columns if c not in (point_id, x, y)]
    right = points.select(F.col(point_id).alias("near_id"), F.col(x).cast("double").alias("__x"), F.col(y).cast("double").alias("__y"), *kept).where(placed)
    left = queries.select(F.col(query_id).alias(query_id), F.col(x).cast("double").alias("__x"), F.col(y).cast("double").alias("__y")).where(placed)
    tree = blocks.fitted(right, "__x", "__y", max(blocks.POINTS, 16 * k))

    @F.pandas_udf("int")
    def holding(px: pd.Series, py: pd.Series) -> pd.Series:
        return pd.Series(tree.holding(np.column_stack([px, py])))

    right, left = (rows.withColumn("__block", holding("__x", "__y")) for rows in (right, left))
    turn = F.row_number().over(Window.partitionBy("__block", "__x", "__y").orderBy("near_id"))
    right = dealt(right, "__block").withColumn("__turn", turn).where(F.col("__turn") <= k).drop("__turn")

    def wanted(there: pa.Table, asked: pa.Table) -> pa.Table:
        at, to = _places(asked), _places(there)
        bound = np.full(len(at), float(reach))
        if len(to) >= k:
            for some in _slices(len(at), len(to)):
                bound[some] = np.minimum(np.partition(_distances(at[some], to), k - 1, axis=1)[:, k - 1], reach)
        who, block = tree.within(at, bound)
        return asked.drop_columns("__block").take(who).append_column("__bound", pa.array(bound[who])).append_column("__block", pa.array(block, pa.int32()))

    def met(there: pa.Table, asked: pa.Table) -> pa.Table:
        there = there.take(pc.sort_indices(there, sort_keys=[("near_id", "ascending")], null_placement="at_start"))
        at, to, bound = _places(asked), _places(there), asked["__bound"].to_numpy()
        told = [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))]
        for some in _slices(len(at), len(to)):
            d = _distances(at[some], to)
            who, which = np.nonzero(d <= bound[some, None])
            d = d[who, which]
            order = np.lexsort((which, d, who))
            who, which, d = who[order], which[order], d[order]
            first = np.arange(len(who)) - np.searchsorted(who, who) < k
            told.append((who[first] + some.start, which[first], d[first]))
        who, which, d = (np.concatenate(part) for part in zip(*told, strict=True))
        out = asked.select([query_id]).take(who)
        for c in ("near_id", *kept):
            out = out.append_column(c, there[c].take(pa.array(which)))
        return out.append_column("distance", pa.array(d))

    types = {f.name: f.dataType for f in (*right.schema, *left.schema)}
    types |= {"__bound": types["__x"], "distance": types["__x"]}
    asked = right.groupBy("__block").cogroup(left.groupBy("__block")).applyInArrow(wanted, _schema(types, query_id, "__x", "__y", "__bound", "__block"))
    found = right.groupBy("__block").cogroup(asked.groupBy("__block")).applyInArrow(met, _schema(types, query_id, "near_id", *kept, "distance"))
    place = F.row_number().over(Window.partitionBy(query_id).orderBy("distance", "near_id"))
    return found.withColumn("place", place).where(F.col("place") <= k)


def _schema(types: dict[str, DataType], *names: str) -> StructType:
    return StructType([StructField(n, types[n]) for n in names])


def _places(rows: pa.Table) -> np.ndarray:
    return np.column_stack([rows["__x"].to_numpy(), rows["__y"].to_numpy()])


def _slices(n: int, width: int) -> list[slice]:
    """n rows of width in slices of CHUNK values."""
    step = max(CHUNK // max(width, 1), 1)
    return [slice(i, i + step) for i in range(0, n, step)]


def _distances(at: np.ndarray, to: np.ndarray) -> np.ndarray:
    return blocks.apart(*(at[:, None, a] - to[None, :, a] for a in (0, 1)))
