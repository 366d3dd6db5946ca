"""How work is dealt and who meets by a broadcast, where a table's bytes say nothing about what is made of it."""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldspark.operators import grid, solve, sparse

PLANE = {"x": (21, 0.0, 1.0), "y": (21, 0.0, 1.0)}


def _points(spark, many: int = 40):
    i = F.col("id")
    return spark.range(many).coalesce(1).select(i.alias("point"), (i * 7 % 20 + 0.25).alias("x"), (i * 3 % 20 + 0.5).alias("y"), (i * 1.0).alias("value"))


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_points_of_one_file_are_dealt_before_they_are_multiplied(spark):
    """A small file is read by one task; its points must not all be expanded there."""
    h = sparse.observation_operator(_points(spark), PLANE, "point")
    assert h.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_fields_meet_the_nodes_as_one_row_a_point(spark):
    """The join with the coefficients comes before the 16 rows a point: they do not move through a shuffle."""
    nodes = grid.mesh(spark, PLANE).select("ix", "iy", (F.col("ix") * 2.0 + F.col("iy")).alias("f"))
    met = sparse.evaluated(_points(spark), nodes, PLANE, "point", ["f"])
    plan = _plan(met)
    assert plan.index("explode(patch") < plan.index("Join")
    told = met.join(_points(spark), "point").where("x > 1 AND y > 1 AND x < 19 AND y < 19").collect()
    assert len(told) > 20
    for r in told:  # splines keep straight fields
        assert abs(r.f - (2 * r.x + r.y)) < 1e-12 and abs(r.f_x - 2) < 1e-12 and abs(r.f_y - 1) < 1e-12


def test_rows_are_never_broadcast(spark, tmp_path):
    """A table of rows that is small as a file has many rows: it must not pass through the driver."""
    _points(spark).write.parquet(str(tmp_path / "p"))
    points = spark.read.parquet(str(tmp_path / "p"))
    h = sparse.observation_operator(points, PLANE, "point")
    y = points.select(F.col("point").alias("row"), F.col("value").alias("v"))
    assert "Broadcast" not in _plan(solve.transposed(h, y))
    x = points.select(F.col("point").alias("col"), F.lit(1.0).alias("x"))
    d = y.select("row", F.col("v").alias("d"), F.lit(1.0).alias("weight"))
    assert _plan(sparse.gradient(h, d, x)).count("BroadcastHashJoin") <= 1  # the state's own, by its columns


def test_nearest_takes_equal_distances_by_id(spark):
    """0.42 and 0.56 make 0.7 as 0 and 0.7 do; hypot puts them apart in the last digit."""
    rows = spark.createDataFrame([(1, 0.42, 0.56, 1.0), (2, 0.0, 0.7, 2.0), (0, 0.0, 0.0, 0.0)], "id long, x double, y double, value double")
    found = grid.nearest(rows.where("id = 0"), rows.where("id > 0"), "x", "y", 1, 2.0, "id", "id")
    assert [r.near_id for r in found.collect()] == [1]
