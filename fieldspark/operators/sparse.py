"""The observation operator as a table, its layout by columns, and products with it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .grid import dealt, patches, spline_weights, weighted_stencil

#: Keys of a block whose counts are summed before the blocks themselves are.
BLOCK = 4096


def observation_operator(points: DataFrame, axes: dict[str, tuple[int, float, float]], row: str) -> DataFrame:
    """H as (row, col, h): the spline weights of the nodes around each point; col numbers the nodes, the first axis slowest."""
    col = F.lit(0).cast("long")
    for name, (n, _, _) in axes.items():
        col = col * n + F.col(f"i{name}")
    points = dealt(points.select(F.col(row).alias("row"), *axes), "row")  # sums by row, and joins on it, find the entries in place
    return weighted_stencil(points, axes).select("row", col.alias("col"), F.col("weight").alias("h")).where("h <> 0")


def offsets(entries: DataFrame, key: str) -> DataFrame:
    """key, entries, first: how many entries each key has, and how many lie before its first: the index of a compressed layout.

    Sums run within blocks of keys and over blocks, so that no task sorts all keys.
    """
    counts = entries.groupBy(key).agg(F.count("*").alias("entries")).withColumn("block", F.floor(F.col(key) / BLOCK))
    blocks = counts.groupBy("block").agg(F.sum("entries").alias("own"))
    before = F.sum("own").over(Window.orderBy("block")) - F.col("own")  # a row for BLOCK keys
    blocks = blocks.select("block", before.alias("before"))
    within = F.sum("entries").over(Window.partitionBy("block").orderBy(key).rowsBetween(Window.unboundedPreceding, 0)) - F.col("entries")
    return counts.withColumn("within", within).join(blocks, "block").select(key, "entries", (F.col("before") + F.col("within")).alias("first"))


def gradient(h: DataFrame, d: DataFrame, x: DataFrame) -> DataFrame:
    """The cost's gradient x + H'W(Hx - d) as (col, g); d is (row, d, weight), x is (col, x).  With d 0: the Hessian times x."""
    seen = h.join(x, "col").groupBy("row").agg(F.sum(F.col("h") * F.col("x")).alias("v"))
    # rows grow with the observations: merged, for what Spark believes to be small it sends through the driver
    miss = d.hint("merge").join(seen, "row", "left").select("row", (F.col("weight") * (F.coalesce("v", F.lit(0.0)) - F.col("d"))).alias("m"))
    back = h.join(miss.hint("merge"), "row").groupBy("col").agg(F.sum(F.col("h") * F.col("m")).alias("b"))
    return x.join(back, "col", "full").select("col", (F.coalesce("x", F.lit(0.0)) + F.coalesce("b", F.lit(0.0))).alias("g"))


def evaluated(points: DataFrame, nodes: DataFrame, axes: dict[str, tuple[int, float, float]], row: str, fields: list[str]) -> DataFrame:
    """row and each field's value and first derivative along each axis, from its coefficients at the nodes around the point."""
    cell = [f"c{name}" for name in axes]
    points = points.select(row, *axes, *[F.floor((F.col(name) - low) / step).cast("int").alias(f"c{name}") for name, (_, low, step) in axes.items()])
    # a point meets the nodes around it as one row of its cell; its weights are worked out once, so that terms are products only
    met = spline_weights(dealt(points, *cell).join(patches(nodes, axes, fields).hint("merge"), cell), axes, (0, 1)).withColumn("node", F.explode("patch"))
    told = [F.col(f"node.{f}").alias(f"__f{k}") for k, f in enumerate(fields)]
    at = {name: F.col(f"__{name}")[F.col(f"node.p{name}")] for name in axes}
    met = met.select(row, *told, *[at[name][f"w{o}"].alias(f"__w{o}{name}") for name in axes for o in (0, 1)])

    def weight(along: str | None) -> Column:
        out = None
        for name in axes:
            one = F.col(f"__w{int(name == along)}{name}")
            out = one if out is None else out * one
        return out

    # the weights and their products as rows of their own: the sums' code stays small
    met = met.select(row, *[f"__f{k}" for k in range(len(fields))], *[weight(a).alias(f"__a{i}") for i, a in enumerate((None, *axes))])
    sums = [F.sum(F.col(f"__f{k}") * F.col(f"__a{i}")).alias(f if a is None else f"{f}_{a}") for k, f in enumerate(fields) for i, a in enumerate((None, *axes))]
    return met.groupBy(row).agg(*sums)
