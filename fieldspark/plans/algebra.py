"""Queries on the sparse operator, three-dimensional spline fields, background joins and settings."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from ..operators import grid, solve, sparse
from .grids import _B, _NODES, AXES
from .tables import COLUMNS, OBS, SAMPLES, columns, observations, read, registered, rounded, samples

CUBE = {"x": (21, 0.0, 1.0), "y": (21, 0.0, 1.0), "z": (11, 0.0, 5.0)}
_B1 = "CASE WHEN abs({0}) < 2 THEN (pow(2 - abs({0}), 2) / 6 - pow(greatest(1 - abs({0}), 0), 2) * 4 / 6) * 3 * CASE WHEN {0} > 0 THEN -1 ELSE 1 END ELSE 0 END"
_H = f"""{SAMPLES}, {_NODES}, h0 AS (SELECT point AS row, CAST(ix AS BIGINT) * 21 + iy AS col, ({_B.format('(x - ix)')}) * ({_B.format('(y - iy)')}) AS h
    FROM samples JOIN nx ON ix BETWEEN floor(x) - 1 AND floor(x) + 2 JOIN ny ON iy BETWEEN floor(y) - 1 AND floor(y) + 2), h AS (SELECT * FROM h0 WHERE h <> 0)"""


def _h(spark, sf_dir):
    return sparse.observation_operator(samples(spark, sf_dir), AXES, "point")


@registered(f"WITH {_H} SELECT row, col, round(h, 6) AS h FROM h")
def sol06_observation_operator(spark, sf_dir):
    return rounded(_h(spark, sf_dir), "row", "col", places=6)


@registered(f"WITH {_H}, n AS (SELECT col, count(*) AS entries FROM h GROUP BY col) SELECT col, entries, CAST(sum(entries) OVER (ORDER BY col) - entries AS BIGINT) AS first FROM n")
def agg12_column_offsets(spark, sf_dir):
    """The compressed layout of H by columns."""
    return sparse.offsets(_h(spark, sf_dir), "col")


@registered(f"""WITH {_H}, y AS (SELECT point AS row, value / 1000 AS v, 1 / (1 + point % 3)::DOUBLE AS r FROM samples)
    SELECT col, round(sum(h * v * r), 5) + 0 AS weighted FROM h JOIN y USING (row) GROUP BY col""")
def sol07_weighted_transpose(spark, sf_dir):
    """H' R^-1 y."""
    y = samples(spark, sf_dir).select(F.col("point").alias("row"), (F.col("value") / 1000 / (1 + F.col("point") % 3)).alias("v"))
    return rounded(solve.transposed(_h(spark, sf_dir), y).withColumnRenamed("v", "weighted"), "col", places=5)


_STATE = "x0 AS (SELECT CAST(i AS BIGINT) AS col, sin(i * 0.1::DOUBLE) AS x FROM (SELECT unnest(range(0, 441)) AS i))"


def _gradient_sql(d: str) -> str:
    return f"""WITH {_H}, {_STATE}, hx AS (SELECT row, sum(h * x) AS v FROM h JOIN x0 USING (col) GROUP BY row
        ), m AS (SELECT point AS row, (coalesce(v, 0) - {d}) / (1 + point % 3)::DOUBLE AS m FROM samples LEFT JOIN hx ON row = point
        ), b AS (SELECT col, sum(h * m) AS b FROM h JOIN m USING (row) GROUP BY col)
        SELECT col, round(x + coalesce(b, 0), 5) + 0 AS g FROM x0 LEFT JOIN b USING (col)"""


def _gradient(spark, sf_dir, d):
    x = spark.range(441).select(F.col("id").alias("col"), F.sin(F.col("id") * 0.1).alias("x"))
    told = samples(spark, sf_dir).select(F.col("point").alias("row"), d.alias("d"), (1 / (1 + F.col("point") % 3)).alias("weight"))
    return rounded(sparse.gradient(_h(spark, sf_dir), told, x), "col", places=5)


@registered(_gradient_sql("value / 1000"))
def sol08_gradient(spark, sf_dir):
    return _gradient(spark, sf_dir, F.col("value") / 1000)


@registered(_gradient_sql("0"))
def sol08_hessian_product(spark, sf_dir):
    return _gradient(spark, sf_dir, F.lit(0.0))


@registered("SELECT DISTINCT l_partkey AS col, 0.0::DOUBLE AS gradient FROM lineitem")
def sol11_gradient_at_minimum(spark, sf_dir):
    """The gradient where the minimiser ends: zero to six places for every element of the state."""
    lines = read(spark, sf_dir, "lineitem")
    h = lines.groupBy(F.col("l_orderkey").alias("row"), F.col("l_partkey").alias("col")).agg((F.sum("l_quantity") / 50).alias("h"))
    d = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("row"), (F.col("o_totalprice") / 100_000).alias("d"), F.lit(0.2).alias("weight"))
    return rounded(sparse.gradient(h, d, solve.conjugate_gradient(h, d, tolerance=1e-9)).withColumnRenamed("g", "gradient"), "col", places=6)


@registered(f"WITH {COLUMNS} SELECT gate, count(*) AS n, round(sum(vr * sw), 2) + 0 AS dot, round(sqrt(sum(vr * vr)), 4) AS vr_norm, round(sqrt(sum(sw * sw)), 4) AS sw_norm FROM columns GROUP BY gate")
def agg10_dots_and_norms(spark, sf_dir):
    c = F.col
    found = columns(spark, sf_dir).groupBy("gate").agg(F.count("*").alias("n"), (F.round(F.sum(c("vr") * c("sw")), 2) + 0.0).alias("dot"), F.sqrt(F.sum(c("vr") ** 2)).alias("vr_norm"), F.sqrt(F.sum(c("sw") ** 2)).alias("sw_norm"))
    return rounded(found, "gate", "n", "dot")


_CUBE_JOIN = "JOIN nx ON ix BETWEEN floor(x) - 1 AND floor(x) + 2 JOIN ny ON iy BETWEEN floor(y) - 1 AND floor(y) + 2 JOIN nz ON iz BETWEEN floor(z / 5) - 1 AND floor(z / 5) + 2"
_W = f"({_B.format('(x - ix)')}) * ({_B.format('(y - iy)')}) * ({_B.format('(z / 5 - iz)')})"
_FLOW = {"rho": "1.0::DOUBLE", "ru": "value / 100", "rv": "z / 10", "rw": "(point % 100) / 50.0::DOUBLE"}


def _cube_sql() -> str:
    sums = ", ".join(f"sum({v} * {_W}) AS {n}" for n, v in _FLOW.items())
    along = {"": _W, "_x": f"({_B1.format('(x - ix)')}) * ({_B.format('(y - iy)')}) * ({_B.format('(z / 5 - iz)')})", "_y": f"({_B.format('(x - ix)')}) * ({_B1.format('(y - iy)')}) * ({_B.format('(z / 5 - iz)')})", "_z": f"({_B.format('(x - ix)')}) * ({_B.format('(y - iy)')}) * ({_B1.format('(z / 5 - iz)')}) / 5"}
    told = ", ".join(f"sum({n} * {w}) AS {n}{a}" for n in _FLOW for a, w in along.items())
    return f"""WITH {SAMPLES}, {_NODES}, nz AS (SELECT CAST(unnest(range(0, 11)) AS INTEGER) AS iz), nodes AS (SELECT ix, iy, iz, {sums} FROM samples {_CUBE_JOIN} GROUP BY ix, iy, iz
    ), f AS (SELECT point, {told} FROM samples {_CUBE_JOIN} JOIN nodes USING (ix, iy, iz) GROUP BY point)"""


def _cube(spark, sf_dir):
    """Momentum and density of scattered samples on a spline grid, evaluated with derivatives at the samples' places."""
    c, rows = F.col, samples(spark, sf_dir)
    rows = rows.withColumns({"rho": F.lit(1.0), "ru": c("value") / 100, "rv": c("z") / 10, "rw": (c("point") % 100) / 50.0})
    nodes = grid.weighted_stencil(grid.dealt(rows), CUBE).groupBy("ix", "iy", "iz").agg(*[F.sum(c(n) * c("weight")).alias(n) for n in _FLOW])
    return sparse.evaluated(rows, nodes, CUBE, "point", list(_FLOW))


@registered(_cube_sql() + " SELECT point, " + ", ".join(f"round({n}{a}, 4) + 0 AS {n}{a}" for n in _FLOW for a in ("", "_x", "_y", "_z")) + " FROM f")
def dg01_spline_fields(spark, sf_dir):
    """Four fields and their derivatives along three axes, from 64 nodes around each point."""
    return rounded(_cube(spark, sf_dir), "point")


_TERMS = [(u, a) for u in "uvw" for a in "xyz"]


@registered(_cube_sql() + " SELECT point, " + ", ".join(f"round(100 * (r{u}_{a} - r{u} / rho * rho_{a}) / rho, 4) + 0 AS d{u}_d{a}" for u, a in _TERMS) + ", round(ru_x + rv_y + rw_z, 4) + 0 AS residual FROM f WHERE rho > 0.001")
def dg02_velocity_gradients(spark, sf_dir):
    """All nine terms of the velocity gradient, and what mass continuity leaves over."""
    c, f = F.col, _cube(spark, sf_dir).where("rho > 0.001")
    terms = [(100 * (c(f"r{u}_{a}") - c(f"r{u}") / c("rho") * c(f"rho_{a}")) / c("rho")).alias(f"d{u}_d{a}") for u, a in _TERMS]
    return rounded(f.select("point", *terms, (c("ru_x") + c("rv_y") + c("rw_z")).alias("residual")), "point")


@registered(_cube_sql() + f""", g AS (SELECT f.point, s.y, {", ".join(f"100 * (r{u}_{a} - r{u} / rho * rho_{a}) / rho AS d{u}_d{a}" for u, a in _TERMS)} FROM f JOIN samples s USING (point) WHERE rho > 0.001)
    SELECT point, round(dv_dx - du_dy, 4) + 0 AS vorticity, round(dv_dx - du_dy + 2e5 * 7.2921e-5::DOUBLE * sin(radians(y)), 4) + 0 AS absolute_vorticity, round(du_dx + dv_dy, 4) + 0 AS divergence,
           round(sqrt((du_dx - dv_dy) ** 2 + (dv_dx + du_dy) ** 2), 4) + 0 AS strain, round((du_dx - dv_dy) ** 2 + (dv_dx + du_dy) ** 2 - (dv_dx - du_dy) ** 2, 3) + 0 AS okubo_weiss FROM g""")
def dg04_absolute_vorticity(spark, sf_dir):
    """Rotation, with the planet's at each latitude, divergence and strain of the fields, in 1e-5 a second."""
    c, f = F.col, _cube(spark, sf_dir).where("rho > 0.001")
    f = f.select("point", *[(100 * (c(f"r{u}_{a}") - c(f"r{u}") / c("rho") * c(f"rho_{a}")) / c("rho")).alias(f"d{u}_d{a}") for u, a in _TERMS])
    f = f.join(samples(spark, sf_dir).select("point", "y"), "point")
    turn, shear = c("dv_dx") - c("du_dy"), (c("du_dx") - c("dv_dy")) ** 2 + (c("dv_dx") + c("du_dy")) ** 2
    planet = 2e5 * 7.2921e-5 * F.sin(F.radians("y"))
    out = f.select("point", turn.alias("vorticity"), (turn + planet).alias("absolute_vorticity"), (c("du_dx") + c("dv_dy")).alias("divergence"), F.sqrt(shear).alias("strain"), (F.round(shear - turn * turn, 3) + 0.0).alias("okubo_weiss"))
    return rounded(out, "point", "okubo_weiss")


@registered(f"""WITH {SAMPLES}, {_NODES}, col AS (SELECT x, y, max(z) AS top, avg(value) AS value FROM samples GROUP BY x, y), near AS (
        SELECT ix, iy, top, value, (x - ix) * (x - ix) + (y - iy) * (y - iy) AS r2 FROM col, nx, ny WHERE (x - ix) * (x - ix) + (y - iy) * (y - iy) < 4
    ), w AS (SELECT *, (4 - r2) / (4 + r2) AS w FROM near) SELECT ix, iy, round(sum(w), 4) AS weight, count(*) AS n_points, round(sum(w * value) / sum(w), 4) AS mean FROM w GROUP BY ix, iy""")
def jn06_background_columns(spark, sf_dir):
    """Grid columns and the background's columns within a horizontal radius: heights play no part in who meets."""
    one = samples(spark, sf_dir).groupBy("x", "y").agg(F.avg("value").alias("value"))
    return rounded(grid.weighted_mean(one, AXES, 2.0, "value", "cressman"), "ix", "iy", "n_points")


@registered(f"""WITH {SAMPLES}, t AS (SELECT CAST(floor(x) AS INTEGER) AS ix, CAST(floor(y) AS INTEGER) AS iy, avg(value) / 100 AS height FROM samples WHERE point % 3 = 0 GROUP BY ALL)
    SELECT point, CASE WHEN height IS NULL OR z >= height THEN value END AS value FROM samples LEFT JOIN t ON ix = floor(x) AND iy = floor(y)""")
def jn10_terrain_mask(spark, sf_dir):
    """Values below the terrain of their column go missing: by the column's key, not by the order of rows."""
    rows = samples(spark, sf_dir).withColumns({"ix": F.floor("x").cast("int"), "iy": F.floor("y").cast("int")})
    terrain = rows.where("point % 3 = 0").groupBy("ix", "iy").agg((F.avg("value") / 100).alias("height"))
    return rows.join(terrain, ["ix", "iy"], "left").select("point", F.when(F.col("height").isNull() | (F.col("z") >= F.col("height")), F.col("value")).alias("value"))


@registered(f"""WITH {SAMPLES}, {_NODES} SELECT 'sample' AS kind, point AS id, round(value, 4) AS value, 1.0::DOUBLE AS inverse_error FROM samples
    UNION ALL SELECT 'continuity', CAST(ix AS BIGINT) * 21 + iy, 0, 0.5 FROM nx, ny""")
def set02_continuity_rows(spark, sf_dir):
    """Rows of mass continuity, one for each node, behind the background's own."""
    own = samples(spark, sf_dir).select(F.lit("sample").alias("kind"), F.col("point").alias("id"), F.round("value", 4).alias("value"), F.lit(1.0).alias("inverse_error"))
    nodes = grid.mesh(spark, AXES).select(F.lit("continuity").alias("kind"), (F.col("ix").cast("long") * 21 + F.col("iy")).alias("id"), F.lit(0.0).alias("value"), F.lit(0.5).alias("inverse_error"))
    return own.unionByName(nodes)


@registered(f"WITH {OBS} SELECT event_id, second FROM obs")
def flt02_background_window(spark, sf_dir):
    """Both ends belong to the background's window, and a row outside it fails the job: here the window holds them all."""
    rows = observations(spark, sf_dir)
    first, last = F.lit(0), F.lit(4102444800)
    held = F.when(F.col("second").between(first, last), F.col("second")).otherwise(F.raise_error(F.lit("a background row lies outside the time window")).cast("long"))
    return rows.select("event_id", held.alias("second"))


_NEEDED = ["mode", "incr", "radius"]


@registered("""WITH s AS (SELECT n_nationkey AS run, unnest(['mode', 'incr', 'radius', 'mask']) AS key FROM nation), told AS (SELECT * FROM s WHERE (length(key) + run) % 5 <> 0)
    SELECT n_nationkey AS run, k AS missing FROM nation, (SELECT unnest(['mode', 'incr', 'radius']) AS k) WHERE NOT EXISTS (SELECT 1 FROM told WHERE run = n_nationkey AND key = k)""")
def flt13_missing_settings(spark, sf_dir):
    """Of each run's settings: required keys that it lacks."""
    runs = read(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("run"))
    told = runs.withColumn("key", F.explode(F.array(*[F.lit(k) for k in [*_NEEDED, "mask"]]))).where((F.length("key") + F.col("run")) % 5 != 0)
    needed = runs.withColumn("missing", F.explode(F.array(*[F.lit(k) for k in _NEEDED])))
    return needed.join(told, (needed.run == told.run) & (needed.missing == told.key), "left_anti")


@registered("""WITH s AS (SELECT n_regionkey AS run, 'key' || (n_nationkey % 3) AS key, CASE WHEN n_nationkey % 4 > 0 THEN n_nationkey % 4 END AS iteration, max(n_nationkey) AS value FROM nation GROUP BY ALL
    ), i AS (SELECT DISTINCT run, key, k AS iteration FROM s, (SELECT unnest([1, 2, 3]) AS k))
    SELECT i.run, i.key, CAST(i.iteration AS INTEGER) AS iteration, coalesce(o.value, b.value) AS value FROM i LEFT JOIN s o ON o.run = i.run AND o.key = i.key AND o.iteration = i.iteration
    LEFT JOIN s b ON b.run = i.run AND b.key = i.key AND b.iteration IS NULL""")
def prj21_iteration_settings(spark, sf_dir):
    """Settings of each outer iteration: its own value of a key where there is one, the plain one otherwise, else NULL."""
    k = F.col("n_nationkey")
    told = read(spark, sf_dir, "nation").groupBy(F.col("n_regionkey").alias("run"), F.concat(F.lit("key"), k % 3).alias("key"), F.when(k % 4 > 0, k % 4).cast("int").alias("iteration")).agg(F.max(k).alias("value"))
    plain = F.max(F.when(F.col("iteration").isNull(), F.col("value")))
    own = F.map_from_entries(F.collect_list(F.when(F.col("iteration").isNotNull(), F.struct("iteration", "value"))))
    keys = told.groupBy("run", "key").agg(plain.alias("plain"), own.alias("own")).withColumn("iteration", F.explode(F.array(*[F.lit(i) for i in (1, 2, 3)])))
    return keys.select("run", "key", "iteration", F.coalesce(F.try_element_at("own", "iteration"), F.col("plain")).alias("value"))


def smoothed(lines, key: str, place: str, value: str, most: int):
    """Along each line: value without wavenumbers above most, by a real Fourier transform; a line is a group of bounded size."""

    def work(line: pd.DataFrame) -> pd.DataFrame:
        line = line.sort_values(place)
        kept = np.fft.rfft(line[value].to_numpy())
        kept[most + 1 :] = 0
        return line[[key, place]].assign(value=np.fft.irfft(kept, len(line)))

    return lines.groupBy(key).applyInPandas(work, f"{key} int, {place} int, value double")


@registered(f"""WITH {SAMPLES}, {_NODES}, g AS (SELECT nx.ix, ny.iy, coalesce(sum(value) / 1000, 0) AS v FROM nx CROSS JOIN ny LEFT JOIN samples ON floor(x) = nx.ix AND floor(y) = ny.iy GROUP BY ALL
    ), k AS (SELECT CAST(unnest(range(0, 6)) AS INTEGER) AS k), c AS (
        SELECT iy, k, (CASE WHEN k = 0 THEN 1 ELSE 2 END) * sum(v * cos(2 * pi() * k * ix / 21)) / 21 AS a, (CASE WHEN k = 0 THEN 1 ELSE 2 END) * sum(v * sin(2 * pi() * k * ix / 21)) / 21 AS b FROM g, k GROUP BY iy, k)
    SELECT c.iy, nx.ix, round(sum(a * cos(2 * pi() * k * nx.ix / 21) + b * sin(2 * pi() * k * nx.ix / 21)), 5) + 0 AS value FROM c, nx GROUP BY c.iy, nx.ix""")
def sol05_periodic_lines(spark, sf_dir):
    """Lines of a periodic grid without their short waves."""
    held = samples(spark, sf_dir).groupBy(F.floor("x").cast("int").alias("ix"), F.floor("y").cast("int").alias("iy")).agg((F.sum("value") / 1000).alias("v"))
    lines = grid.mesh(spark, AXES).select("ix", "iy").join(held, ["ix", "iy"], "left").withColumn("v", F.coalesce("v", F.lit(0.0)))
    return rounded(smoothed(lines, "iy", "ix", "v", 5), "iy", "ix", places=5)
