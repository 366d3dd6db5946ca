"""Queries on gates, columns and grids: aggregations, ordered work, range joins, stencils."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import radar, spline
from ..operators import grid
from .tables import COLUMNS, GATES, SAMPLES, columns, gates, read, registered, rounded, samples

AXES = {"x": (21, 0.0, 1.0), "y": (21, 0.0, 1.0)}
_NODES = "nx AS (SELECT CAST(unnest(range(0, 21)) AS INTEGER) AS ix), ny AS (SELECT CAST(unnest(range(0, 21)) AS INTEGER) AS iy)"


def _near(kernel):
    return f"""WITH {SAMPLES}, {_NODES}, near AS (
        SELECT ix, iy, value, (x - ix) * (x - ix) + (y - iy) * (y - iy) AS r2 FROM samples, nx, ny WHERE (x - ix) * (x - ix) + (y - iy) * (y - iy) < 2.25
    ), w AS (SELECT *, {kernel} AS w FROM near)
    SELECT ix, iy, round(sum(w), 4) AS weight, count(*) AS n_points, round(sum(w * value) / sum(w), 4) AS mean FROM w GROUP BY ix, iy"""


@registered(_near("exp(-ln(10) * r2 / 2.25::DOUBLE)"))
def agg02_kernel_mean(spark, sf_dir):
    return rounded(grid.weighted_mean(samples(spark, sf_dir), AXES, 1.5, "value"), "ix", "iy", "n_points")


@registered(_near("(2.25::DOUBLE - r2) / (2.25::DOUBLE + r2)"))
def agg03_cressman_mean(spark, sf_dir):
    return rounded(grid.weighted_mean(samples(spark, sf_dir), AXES, 1.5, "value", "cressman"), "ix", "iy", "n_points")


_B = "CASE WHEN abs({0}) < 2 THEN pow(2 - abs({0}), 3) / 6 - pow(greatest(1 - abs({0}), 0), 3) * 4 / 6 ELSE 0 END"


@registered(f"""WITH {SAMPLES}, {_NODES}, s AS (SELECT ix, iy, value * ({_B.format('(x - ix)')}) * ({_B.format('(y - iy)')}) AS part
        FROM samples JOIN nx ON ix BETWEEN floor(x) - 1 AND floor(x) + 2 JOIN ny ON iy BETWEEN floor(y) - 1 AND floor(y) + 2)
    SELECT ix, iy, round(sum(part), 4) AS total, count(*) AS n_parts FROM s GROUP BY ix, iy""")
def agg13_spline_gather(spark, sf_dir):
    parts = grid.stencil(samples(spark, sf_dir), AXES)
    part = F.col("value") * spline.basis(F.col("delta_x")) * spline.basis(F.col("delta_y"))
    return rounded(parts.groupBy("ix", "iy").agg(F.sum(part).alias("total"), F.count("*").alias("n_parts")), "ix", "iy", "n_parts")


@registered(f"""WITH {SAMPLES}, {_NODES}, c AS (SELECT ix, iy, sin(ix * 0.3::DOUBLE) * cos(iy * 0.2::DOUBLE) AS c FROM nx, ny)
    SELECT point, round(sum(c * ({_B.format('(x - ix)')}) * ({_B.format('(y - iy)')})), 4) + 0 AS field
    FROM samples JOIN c ON ix BETWEEN floor(x) - 1 AND floor(x) + 2 AND iy BETWEEN floor(y) - 1 AND floor(y) + 2 GROUP BY point""")
def dg01_spline_value(spark, sf_dir):
    nodes = grid.mesh(spark, AXES).select("ix", "iy", (F.sin(F.col("ix") * 0.3) * F.cos(F.col("iy") * 0.2)).alias("c"))
    met = grid.stencil(samples(spark, sf_dir), AXES).join(nodes, ["ix", "iy"])
    part = F.col("c") * spline.basis(F.col("delta_x")) * spline.basis(F.col("delta_y"))
    return rounded(met.groupBy("point").agg(F.sum(part).alias("field")), "point")


@registered(f"""WITH {SAMPLES}, q AS (SELECT point, x, y FROM samples WHERE point % 20 = 0), met AS (
        SELECT q.point, s.point AS near_id, sqrt((q.x - s.x) * (q.x - s.x) + (q.y - s.y) * (q.y - s.y)) AS d, s.value FROM q JOIN samples s ON abs(q.x - s.x) <= 2 AND abs(q.y - s.y) <= 2
    ), r AS (SELECT *, row_number() OVER (PARTITION BY point ORDER BY d, near_id) AS k FROM met WHERE d <= 2)
    SELECT point, count(*) AS n_near, round(avg(value), 4) AS mean, round(max(d), 4) AS farthest FROM r WHERE k <= 4 GROUP BY point""")
def agg05_nearest_mean(spark, sf_dir):
    rows = samples(spark, sf_dir).select("point", "x", "y", "value")
    found = grid.nearest(rows.where("point % 20 = 0"), rows, "x", "y", 4, 2.0, "point", "point")
    return rounded(found.groupBy("point").agg(F.count("*").alias("n_near"), F.avg("value").alias("mean"), F.max("distance").alias("farthest")), "point", "n_near")


def bounded(points, steps: dict[str, float]) -> dict[str, tuple[int, float, float]]:
    """The axes of a mesh that starts at the least coordinate of the points and holds one node a step up to the greatest."""
    ends = points.agg(*[f(c).alias(f"{n}_{c}") for c in steps for n, f in (("low", F.min), ("high", F.max))]).first()  # one row
    return {c: (int((ends[f"high_{c}"] - ends[f"low_{c}"]) / step) + 1, ends[f"low_{c}"], step) for c, step in steps.items()}


_MESH = SAMPLES + ", e AS (SELECT min(x) AS x0, min(y) AS y0, min(z) AS z0, max(x) AS x1, max(y) AS y1, max(z) AS z1 FROM samples), " + ", ".join(
    f"m{a} AS (SELECT CAST(unnest(range(0, CAST(floor(({a}1 - {a}0) / {step}::DOUBLE) AS BIGINT) + 1)) AS INTEGER) AS i{a} FROM e)" for a, step in (("x", 2.0), ("y", 2.0), ("z", 10.0))
)


@registered(f"WITH {_MESH} SELECT ix, iy, iz, x0 + ix * 2.0::DOUBLE AS x, y0 + iy * 2.0::DOUBLE AS y, z0 + iz * 10.0::DOUBLE AS z FROM e, mx, my, mz")
def jn08_mesh(spark, sf_dir):
    """Every node of a mesh over the samples' domain."""
    axes = bounded(samples(spark, sf_dir), {"x": 2.0, "y": 2.0, "z": 10.0})
    return grid.mesh(spark, axes).select("ix", "iy", "iz", "x", "y", "z")


@registered(f"""WITH {GATES} SELECT ray, CAST(gate // 3 AS INTEGER) AS block, round(avg(vr), 4) AS vr, round(avg(sw), 4) AS sw,
        round(10 * log10(avg(pow(10, dbz * 0.1::DOUBLE))), 4) AS dbz, count(dbz) AS n_dbz FROM gates GROUP BY ALL""")
def agg01_gate_stride(spark, sf_dir):
    rows = gates(spark, sf_dir).groupBy("ray", F.floor(F.col("gate") / 3).cast("int").alias("block"))
    rows = rows.agg(F.avg("vr").alias("vr"), F.avg("sw").alias("sw"), (10 * F.log10(F.avg(radar.linear(F.col("dbz"))))).alias("dbz"), F.count("dbz").alias("n_dbz"))
    return rounded(rows, "ray", "block", "n_dbz")


@registered("""SELECT l_orderkey AS m, round(sum(l_quantity * p_retailprice), 2) AS hx FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1""")
def jn09_sparse_product(spark, sf_dir):
    h = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("m"), F.col("l_partkey").alias("col"), F.col("l_quantity").alias("h"))
    x = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("col"), F.col("p_retailprice").alias("x"))
    return h.join(x, "col").groupBy("m").agg(F.round(F.sum(F.col("h") * F.col("x")), 2).alias("hx"))


_D = "hx AS (SELECT l_orderkey AS m, sum(l_quantity * p_retailprice) AS hx FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1), d AS (SELECT o_totalprice / 1000 - hx / 1000 AS d, 1 + m % 3 AS w FROM hx JOIN orders ON m = o_orderkey)"


def _innovations(spark, sf_dir):
    o = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("m"), "o_totalprice")
    h = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("m"), F.col("l_partkey").alias("col"), F.col("l_quantity").alias("h"))
    x = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("col"), F.col("p_retailprice").alias("x"))
    hx = h.join(x, "col").groupBy("m").agg(F.sum(F.col("h") * F.col("x")).alias("hx"))
    return hx.join(o, "m").select((F.col("o_totalprice") / 1000 - F.col("hx") / 1000).alias("d"), (1 + F.col("m") % 3).alias("w"))


@registered(f"WITH {_D} SELECT round(sqrt(avg(d * d)), 3) AS rms, count(*) AS n FROM d")
def agg07_innovation_rms(spark, sf_dir):
    return _innovations(spark, sf_dir).agg(F.round(F.sqrt(F.avg(F.col("d") * F.col("d"))), 3).alias("rms"), F.count("*").alias("n"))


@registered(f"WITH {_D} SELECT w, round(0.5 * sum(w * d * d), 1) AS cost FROM d GROUP BY w")
def agg09_cost(spark, sf_dir):
    return _innovations(spark, sf_dir).groupBy("w").agg(F.round(0.5 * F.sum(F.col("w") * F.col("d") * F.col("d")), 1).alias("cost"))


@registered(f"""WITH {COLUMNS} SELECT ray, gate, round(sum(sw) OVER (PARTITION BY ray ORDER BY gate ROWS UNBOUNDED PRECEDING), 4) AS running FROM columns""")
def win01_running_sum(spark, sf_dir):
    w = Window.partitionBy("ray").orderBy("gate").rowsBetween(Window.unboundedPreceding, 0)
    return rounded(columns(spark, sf_dir).select("ray", "gate", F.sum("sw").over(w).alias("running")), "ray", "gate")


@registered(f"""WITH {COLUMNS}, f AS (SELECT ray, gate, CASE WHEN sw <= lag(sw) OVER w THEN 1 ELSE 0 END AS new FROM columns WINDOW w AS (PARTITION BY ray ORDER BY gate))
    SELECT ray, gate, CAST(sum(new) OVER (PARTITION BY ray ORDER BY gate ROWS UNBOUNDED PRECEDING) AS BIGINT) AS island FROM f""")
def win02_column_islands(spark, sf_dir):
    w = Window.partitionBy("ray").orderBy("gate")
    rows = columns(spark, sf_dir).withColumn("new", F.when(F.col("sw") <= F.lag("sw").over(w), 1).otherwise(0))
    return rows.select("ray", "gate", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("island"))


@registered(f"""WITH {COLUMNS} SELECT ray, gate, round(CASE WHEN lag(vr) OVER w IS NULL THEN lead(vr) OVER w - vr WHEN lead(vr) OVER w IS NULL THEN vr - lag(vr) OVER w
        ELSE (lead(vr) OVER w - lag(vr) OVER w) / 2 END, 4) + 0 AS slope, round((vr + lead(vr) OVER w) / 2, 4) + 0 AS destaggered FROM columns WINDOW w AS (PARTITION BY ray ORDER BY gate)""")
def win03_differences(spark, sf_dir):
    w = Window.partitionBy("ray").orderBy("gate")
    before, after, v = F.lag("vr").over(w), F.lead("vr").over(w), F.col("vr")
    slope = F.when(before.isNull(), after - v).when(after.isNull(), v - before).otherwise((after - before) / 2)
    return rounded(columns(spark, sf_dir).select("ray", "gate", slope.alias("slope"), ((v + after) / 2).alias("destaggered")), "ray", "gate")


@registered(f"""WITH {COLUMNS} SELECT ray, gate, round(dbz - 2 * coalesce(sum(sw * 150 / 1000) OVER (PARTITION BY ray ORDER BY gate ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 4) AS attenuated,
        round(dbz - (-40 + 20 * log10(distance / 1000)), 4) AS snr FROM columns""")
def utl03_attenuation(spark, sf_dir):
    before = Window.partitionBy("ray").orderBy("gate").rowsBetween(Window.unboundedPreceding, -1)
    c = F.col
    rows = columns(spark, sf_dir).select("ray", "gate", (c("dbz") - 2 * F.coalesce(F.sum(c("sw") * 150 / 1000).over(before), F.lit(0.0))).alias("attenuated"), (c("dbz") - (-40 + 20 * F.log10(c("distance") / 1000))).alias("snr"))
    return rounded(rows, "ray", "gate")


@registered(f"""WITH {GATES} SELECT ray, gate, round(((vr * 5 + 12.5::DOUBLE) % 25 + 25) % 25 - 12.5::DOUBLE, 4) + 0 AS folded FROM gates WHERE abs(vr * 5 - 12.5) > 1e-6 AND abs(vr * 5 + 12.5) > 1e-6""")
def utl07_nyquist_folding(spark, sf_dir):
    rows = gates(spark, sf_dir).where((F.abs(F.col("vr") * 5 - 12.5) > 1e-6) & (F.abs(F.col("vr") * 5 + 12.5) > 1e-6))
    return rounded(rows.select("ray", "gate", radar.folded(F.col("vr") * 5, -12.5, 12.5).alias("folded")), "ray", "gate")


@registered(f"""WITH {COLUMNS}, l AS (SELECT *, distance - CASE WHEN dbz < 15 THEN lag(distance, 4) OVER w WHEN dbz < 30 THEN lag(distance, 2) OVER w ELSE lag(distance, 1) OVER w END AS span FROM columns WINDOW w AS (PARTITION BY ray ORDER BY gate))
    SELECT ray, gate, round(coalesce(sum(2 * span / 1000 * sw) OVER (PARTITION BY ray ORDER BY gate ROWS UNBOUNDED PRECEDING), 0), 4) AS phase FROM l""")
def utl08_differential_phase(spark, sf_dir):
    w = Window.partitionBy("ray").orderBy("gate")
    d = F.col("distance")
    back = F.when(F.col("dbz") < 15, F.lag("distance", 4).over(w)).when(F.col("dbz") < 30, F.lag("distance", 2).over(w)).otherwise(F.lag("distance", 1).over(w))
    rows = columns(spark, sf_dir).withColumn("step", 2 * (d - back) / 1000 * F.col("sw"))
    return rounded(rows.select("ray", "gate", F.coalesce(F.sum("step").over(w.rowsBetween(Window.unboundedPreceding, 0)), F.lit(0.0)).alias("phase")), "ray", "gate")


@registered("""WITH g AS (SELECT l_orderkey % 50 AS i, l_linenumber AS j, avg(l_quantity) AS u, avg(l_discount) AS v FROM lineitem GROUP BY 1, 2), d AS (
        SELECT i, j, lead(u) OVER a - lag(u) OVER a AS ux, lead(v) OVER a - lag(v) OVER a AS vx, lead(u) OVER b - lag(u) OVER b AS uy, lead(v) OVER b - lag(v) OVER b AS vy
        FROM g WINDOW a AS (PARTITION BY j ORDER BY i), b AS (PARTITION BY i ORDER BY j))
    SELECT i, j, round((vx - uy) / 2, 4) + 0 AS vorticity, round((ux + vy) / 2, 4) + 0 AS divergence, round(sqrt((ux - vy) * (ux - vy) + (vx + uy) * (vx + uy)) / 2, 4) AS strain,
           round(((vx - uy) * (vx - uy) - (ux - vy) * (ux - vy) - (vx + uy) * (vx + uy)) / 4, 4) + 0 AS okubo_weiss FROM d""")
def dg04_kinematics(spark, sf_dir):
    g = read(spark, sf_dir, "lineitem").groupBy((F.col("l_orderkey") % 50).alias("i"), F.col("l_linenumber").alias("j")).agg(F.avg("l_quantity").alias("u"), F.avg("l_discount").alias("v"))

    def slope(c, along, across):
        w = Window.partitionBy(across).orderBy(along)
        return (F.lead(c).over(w) - F.lag(c).over(w)) / 2

    g = g.select("i", "j", slope("u", "i", "j").alias("ux"), slope("v", "i", "j").alias("vx"), slope("u", "j", "i").alias("uy"), slope("v", "j", "i").alias("vy"))
    c = F.col
    vort, s1, s2 = c("vx") - c("uy"), c("ux") - c("vy"), c("vx") + c("uy")
    return rounded(g.select("i", "j", vort.alias("vorticity"), (c("ux") + c("vy")).alias("divergence"), F.sqrt(s1 * s1 + s2 * s2).alias("strain"), (vort * vort - s1 * s1 - s2 * s2).alias("okubo_weiss")), "i", "j")
