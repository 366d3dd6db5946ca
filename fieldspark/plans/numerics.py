"""Queries on joins with small sides, single-instrument equations, gradients on the mesh, and the minimiser."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import air, spline, wind
from ..operators import grid, solve
from .grids import _B, _NODES, AXES
from .tables import GATES, OBS, SAMPLES, VAPOR, WIND, gates, observations, read, registered, rounded, samples


@registered(f"""WITH {OBS}, r AS (SELECT event_id, second, row_number() OVER (ORDER BY second, event_id) AS k FROM obs WHERE second % 86400 >= 43200)
    SELECT event_id, second FROM r WHERE k = 1""")
def jn02_reference_time(spark, sf_dir):
    """The first row at or past a time of day, whatever its date."""
    found = observations(spark, sf_dir).where("second % 86400 >= 43200").agg(F.min(F.struct("second", "event_id")).alias("f"))
    return found.where("f IS NOT NULL").select("f.event_id", "f.second")


@registered(f"WITH {GATES} SELECT ray, gate, site, CAST(s_nationkey AS BIGINT) AS header, round(distance + s_acctbal / 100, 4) + 0 AS placed FROM gates JOIN supplier ON site = s_suppkey")
def jn11_site_header(spark, sf_dir):
    sites = read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("site"), F.col("s_nationkey").cast("long").alias("header"), "s_acctbal")
    met = gates(spark, sf_dir).join(sites, "site").withColumn("placed", F.col("distance") + F.col("s_acctbal") / 100)
    return rounded(met.select("ray", "gate", "site", "header", "placed"), "ray", "gate", "site", "header")


@registered(f"""WITH {OBS}, kinds AS (SELECT * FROM (VALUES ('click', 1), ('view', 2), ('purchase', 3)) k(event_type, code))
    SELECT event_id, event_type, CAST(coalesce(code, 0) AS INTEGER) AS code FROM obs LEFT JOIN kinds USING (event_type)""")
def jn12_kind_codes(spark, sf_dir):
    kinds = spark.createDataFrame([("click", 1), ("view", 2), ("purchase", 3)], "event_type string, code int")
    rows = observations(spark, sf_dir).select("event_id", "event_type").join(F.broadcast(kinds), "event_type", "left")  # three rows
    return rows.select("event_id", "event_type", F.coalesce("code", F.lit(0)).alias("code"))


def _each(rows, values, *keep):
    """A row of every value that is there: its number, the value and its inverse error."""
    each = F.array(*[F.struct(F.lit(k).alias("variable"), v.alias("value"), F.lit(1.0 / e).alias("inverse_error")) for k, v, e in values])
    return rounded(rows.select(*keep, F.inline(each)).where("value IS NOT NULL"), *keep, "variable")


def _union(source, *values):
    return " UNION ALL ".join(f"SELECT event_id, CAST({k} AS INTEGER) AS variable, round({v}, 4) + 0 AS value, round(1 / {e}::DOUBLE, 4) AS inverse_error FROM {source} WHERE ({v}) IS NOT NULL" for k, v, e in values)


@registered(f"WITH {OBS}, p AS (SELECT event_id, temperature - (300 - 0.0065::DOUBLE * z) AS t, (pressure * 100 / (287 * temperature) - 1.2::DOUBLE * exp(-z / 9000)) * 100 AS d FROM obs) " + _union("p", (3, "t", 1.5), (5, "d", 0.02)))
def prj04_temperature_profile(spark, sf_dir):
    c = F.col
    return _each(observations(spark, sf_dir), [(3, c("temperature") - (300 - 0.0065 * c("z")), 1.5), (5, (air.dry_density(c("pressure"), c("temperature")) - 1.2 * F.exp(-c("z") / 9000)) * 100, 0.02)], "event_id")


@registered(f"WITH {OBS} " + _union("obs", (1, "speed", 10)))
def prj05_surface_speed(spark, sf_dir):
    return _each(observations(spark, sf_dir), [(1, F.col("speed"), 10)], "event_id")


@registered(f"WITH {OBS}, w AS (SELECT event_id, {WIND} FROM obs) " + _union("w", (0, "u", 2), (1, "v", 2)))
def prj07_lidar_winds(spark, sf_dir):
    u, v = wind.eastward(F.col("speed"), F.col("wdir")), wind.northward(F.col("speed"), F.col("wdir"))
    return _each(observations(spark, sf_dir), [(0, u, 2), (1, v, 2)], "event_id")


@registered(f"""WITH {OBS}, e AS (SELECT *, {VAPOR} AS e FROM obs), q AS (SELECT event_id, temperature - (300 - 0.0065::DOUBLE * z) AS t, 622 * e / (pressure - e) AS q FROM e
    ), p AS (SELECT event_id, t, 0.5::DOUBLE * ((q + 1e-7) - 1e-14 / (q + 1e-7)) - 5 AS b FROM q) """ + _union("p", (3, "t", 2), (4, "b", 0.8)))
def prj08_sounder(spark, sf_dir):
    c = F.col
    ratio = air.mixing_ratio(air.vapor_pressure(c("dewpoint")), c("pressure"))
    return _each(observations(spark, sf_dir), [(3, c("temperature") - (300 - 0.0065 * c("z")), 2), (4, air.widen(ratio) - 5, 0.8)], "event_id")


@registered(f"""WITH {SAMPLES}, {_NODES}, c AS (SELECT ix, iy, 1.2::DOUBLE * exp(-0.013::DOUBLE * ix - 0.021::DOUBLE * iy) AS c FROM nx, ny), f AS (
        SELECT point, sum(c * ({_B.format('(x - ix)')}) * ({_B.format('(y - iy)')})) AS density
        FROM samples JOIN c ON ix BETWEEN floor(x) - 1 AND floor(x) + 2 AND iy BETWEEN floor(y) - 1 AND floor(y) + 2 GROUP BY point)
    SELECT point, round(density, 4) + 0 AS density, round(value * density, 4) + 0 AS scaled FROM f JOIN samples USING (point)""")
def prj16_density_scaling(spark, sf_dir):
    """Values times the background's density, from the spline nodes around each point."""
    nodes = grid.mesh(spark, AXES).select("ix", "iy", (1.2 * F.exp(-0.013 * F.col("ix") - 0.021 * F.col("iy"))).alias("c"))
    met = grid.stencil(samples(spark, sf_dir), AXES).join(nodes, ["ix", "iy"])
    part = F.col("c") * spline.basis(F.col("delta_x")) * spline.basis(F.col("delta_y"))
    found = met.groupBy("point", "value").agg(F.sum(part).alias("density"))
    return rounded(found.select("point", "density", (F.col("value") * F.col("density")).alias("scaled")), "point")


@registered(f"""WITH {OBS}, g AS (SELECT avg(temperature + 0.0098::DOUBLE * z) AS theta FROM obs), z AS (SELECT CAST(unnest(range(10, 2011)) AS BIGINT) AS z), s AS (
        SELECT z, sum(CASE WHEN z = 10 THEN 0 ELSE -9.81::DOUBLE / (1005.7::DOUBLE * (theta + 0.004::DOUBLE * (z - 0.5::DOUBLE))) END) OVER (ORDER BY z) AS fallen FROM z, g)
    SELECT z, round(pow(1.0125::DOUBLE, 287.04::DOUBLE / 1005.7::DOUBLE) + fallen, 8) AS exner FROM s""")
def fn26_hydrostatic_exner(spark, sf_dir):
    """Exner's function from 10 m up in steps of a metre, over air as warm at the ground as the observations say: 2001 levels."""
    z = F.col("z")
    ground = observations(spark, sf_dir).agg(F.avg(F.col("temperature") + 0.0098 * z).alias("theta"))
    step = F.when(z == 10, 0.0).otherwise(-9.81 / (1005.7 * (F.col("theta") + 0.004 * (z - 0.5))))
    levels = ground.select("theta", F.explode(F.sequence(F.lit(10).cast("long"), F.lit(2010).cast("long"))).alias("z")).withColumn("step", step)
    fallen = F.sum("step").over(Window.orderBy("z").rowsBetween(Window.unboundedPreceding, 0))  # the metres of one sounding
    return levels.select("z", F.round(1.0125 ** (287.04 / 1005.7) + fallen, 8).alias("exner"))


_FIELDS = f"""{SAMPLES}, {_NODES}, f AS (SELECT ix, iy, coalesce(sum(value), 0) / 997 AS u, coalesce(sum(z), 0) / 97 AS v, 1.2::DOUBLE - ix * 0.01::DOUBLE AS rho FROM nx CROSS JOIN ny LEFT JOIN samples ON floor(x) = ix AND floor(y) = iy GROUP BY ix, iy
), m AS (SELECT *, rho * u AS ru, rho * v AS rv FROM f)"""


def _slope(value, axis, other):
    w = f"OVER (PARTITION BY {other} ORDER BY {axis})"
    return f"(coalesce(lead({value}) {w}, {value}) - coalesce(lag({value}) {w}, {value})) / (CASE WHEN lead({value}) {w} IS NULL OR lag({value}) {w} IS NULL THEN 1 ELSE 2 END)"


def _fields(spark, sf_dir):
    """Winds on the nodes of a plane: sums of the samples in each cell."""
    held = samples(spark, sf_dir).groupBy(F.floor("x").cast("int").alias("ix"), F.floor("y").cast("int").alias("iy")).agg((F.sum("value") / 997).alias("u"), (F.sum("z") / 97).alias("v"))
    rows = grid.mesh(spark, AXES).select("ix", "iy").join(held, ["ix", "iy"], "left")
    rows = rows.select("ix", "iy", *[F.coalesce(c, F.lit(0.0)).alias(c) for c in "uv"], (1.2 - F.col("ix") * 0.01).alias("rho"))
    return rows.withColumns({"ru": F.col("rho") * F.col("u"), "rv": F.col("rho") * F.col("v")})


def _difference(value, axis, other):
    """Centred differences, one-sided at the ends of an axis."""
    w, c = Window.partitionBy(other).orderBy(axis), F.col(value)
    ahead, behind = F.lead(c).over(w), F.lag(c).over(w)
    return (F.coalesce(ahead, c) - F.coalesce(behind, c)) / F.when(ahead.isNull() | behind.isNull(), 1).otherwise(2)


@registered(f"""WITH {_FIELDS}, d AS (SELECT *, {_slope('ru', 'ix', 'iy')} AS dru, {_slope('rv', 'iy', 'ix')} AS drv, {_slope('rho', 'ix', 'iy')} AS drx, {_slope('rho', 'iy', 'ix')} AS dry FROM m)
    SELECT ix, iy, round(100 * (dru - u * drx) / rho, 4) + 0 AS du_dx, round(100 * (drv - v * dry) / rho, 4) + 0 AS dv_dy, round(dru + drv, 6) + 0 AS residual FROM d""")
def dg05_gradients_and_residual(spark, sf_dir):
    d = _fields(spark, sf_dir).withColumns({"dru": _difference("ru", "ix", "iy"), "drv": _difference("rv", "iy", "ix"), "drx": _difference("rho", "ix", "iy"), "dry": _difference("rho", "iy", "ix")})
    c = F.col
    d = d.select("ix", "iy", (100 * (c("dru") - c("u") * c("drx")) / c("rho")).alias("du_dx"), (100 * (c("drv") - c("v") * c("dry")) / c("rho")).alias("dv_dy"), (F.round(c("dru") + c("drv"), 6) + 0.0).alias("residual"))
    return rounded(d, "ix", "iy", "residual")


@registered(f"""WITH {_FIELDS}, d AS (SELECT *, {_slope('u', 'ix', 'iy')} AS du, {_slope('v', 'ix', 'iy')} AS dv FROM m)
    SELECT ix, iy, round(CASE WHEN ix > 0 THEN du + u / ix END, 4) + 0 AS divergence, round(CASE WHEN ix > 0 THEN dv + v / ix END, 4) + 0 AS vorticity FROM d""")
def dg07_cylindrical(spark, sf_dir):
    """Terms of a cylindrical grid, ix the radius; missing on the axis."""
    d = _fields(spark, sf_dir).withColumns({"du": _difference("u", "ix", "iy"), "dv": _difference("v", "ix", "iy")})
    r, c = F.col("ix"), F.col
    return rounded(d.select("ix", "iy", F.when(r > 0, c("du") + c("u") / r).alias("divergence"), F.when(r > 0, c("dv") + c("v") / r).alias("vorticity")), "ix", "iy")


@registered()
def sol11_conjugate_gradient(spark, sf_dir):
    """The state of least cost for the equations that line items make of parts."""
    lines = read(spark, sf_dir, "lineitem")
    h = lines.groupBy(F.col("l_orderkey").alias("row"), F.col("l_partkey").alias("col")).agg((F.sum("l_quantity") / 50).alias("h"))
    d = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("row"), (F.col("o_totalprice") / 100_000).alias("d"), F.lit(0.2).alias("weight"))
    return rounded(solve.conjugate_gradient(h, d, tolerance=1e-9), "col")
