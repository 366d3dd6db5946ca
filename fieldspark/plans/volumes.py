"""Queries on binary files, pressure levels, smoothed columns and the departures of observations."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import columns as air_columns
from ..operators import solve, sparse
from ..sources import dorade, netcdf, netcdf_observations
from ..sources.place import new_folder
from .algebra import _H, CUBE, _h
from .analysis import _CELLS, cells
from .files import _FLOWN, _K, _flown
from .tables import COLUMNS, OBS, columns, observations, registered, rounded, samples


def _file(spark, name: str) -> str:
    return f"{new_folder(spark, 'netcdf')}/{name}"


def _placed(rows, key: str):
    """rows with irec, their rank by key, which is unique."""
    return rows.join(sparse.offsets(rows, key).select(key, F.col("first").alias("irec")), key)


@registered(f"WITH {_CELLS} SELECT CAST(ix AS DOUBLE) AS x, CAST(iy AS DOUBLE) AS y, iz * 5.0::DOUBLE AS z, round(CAST(CAST(v AS FLOAT) AS DOUBLE), 4) AS v, CASE WHEN v > 0 THEN round(CAST(CAST(v * 2 AS FLOAT) AS DOUBLE), 4) END AS w FROM g")
def snk01_netcdf_grid(spark, sf_dir):
    """A grid written as one netCDF file by many tasks, each at its place, and read back."""
    path, rows = _file(spark, "grid.nc"), cells(spark, sf_dir).withColumn("w", F.when(F.col("v") > 0, F.col("v") * 2))
    axes = {n: [low + step * i for i in range(many)] for n, (many, low, step) in reversed(CUBE.items())}
    netcdf.write_netcdf(rows, path, axes, ["v", "w"], {"v": {"units": "1"}})
    return rounded(netcdf.read_netcdf(spark, path, "x double, y double, z double, v double, w double"), "x", "y", "z")


@registered(_FLOWN + f" SELECT second, round(latitude, 4) AS latitude, round(longitude, 4) AS longitude, round(altitude, 4) AS altitude, {_K.format('t')} AS temperature, {_K.format('td')} AS dewpoint, direction, speed, pressure FROM flown")
def src19_mesonet(spark, sf_dir):
    """Stations' reports: one file of all events, written and read by ranges of records."""
    c, rows = F.col, _placed(_flown(spark, sf_dir), "event_id")
    made = rows.select(
        c("irec").alias("irecNum"), "latitude", "longitude", c("altitude").alias("elevation"), c("second").alias("observationTime"), F.round(c("t") + 273.15, 4).alias("temperature"),
        F.round(c("td") + 273.15, 4).alias("dewpoint"), c("direction").alias("windDir"), c("speed").alias("windSpeed"), (c("pressure") * 100).alias("stationPressure"),
    )
    path = _file(spark, "stations.nc")
    netcdf.write_netcdf(made, path, {"recNum": rows.count()}, made.columns[1:], missing=-9999.0, doubles=True)
    told = netcdf_observations.read_observations(spark, path, "mesonet")
    return rounded(told.where("second IS NOT NULL"), "second")


@registered(_FLOWN + f""", h AS (SELECT *, {_K.format('t')} AS temperature, CAST(event_id % 90 + 5 AS DOUBLE) AS rh FROM flown), s AS (
        SELECT *, ln(exp(5.0065::DOUBLE * ln(273.15::DOUBLE / temperature)) * exp(24.84573::DOUBLE * (1 - 273.15::DOUBLE / temperature)) * rh / 100) AS u FROM h)
    SELECT second, round(latitude, 4) AS latitude, round(longitude, 4) AS longitude, round(altitude, 4) AS altitude, temperature, round(237.3::DOUBLE * u / (17.2694::DOUBLE - u) + 273.15::DOUBLE, 4) AS dewpoint, direction, speed, pressure FROM s""")
def src28_netcdf_sondes(spark, sf_dir):
    """Soundings whose start stands in the file's name, and whose seconds count from there."""
    c, rows = F.col, _placed(_flown(spark, sf_dir), "event_id")
    made = rows.select(
        c("irec").alias("itime"), c("latitude").alias("lat"), c("longitude").alias("lon"), c("altitude").alias("alt"), (c("second") - 1_577_836_800).alias("time"), c("t").alias("tdry"),
        (c("event_id") % 90 + 5).alias("rh"), c("direction").alias("wdir"), c("speed").alias("wspd"), c("pressure").alias("pres"),
    )
    path = _file(spark, "a_sonde_of_one_site_20200101_000000.nc")
    netcdf.write_netcdf(made, path, {"time": rows.count()}, made.columns[1:], missing=-9999.0, doubles=True)
    return rounded(netcdf_observations.read_observations(spark, path, "ict"), "second")


@registered(f"""WITH {COLUMNS}, g AS (SELECT CAST(unnest(range(1, 8)) AS INTEGER) AS gate), r AS (SELECT DISTINCT ray FROM columns)
    SELECT r.ray AS second, CAST(r.ray * 7 % 360 AS DOUBLE) AS azimuth, CAST(r.ray % 60 AS DOUBLE) AS elevation, g.gate * 150.0::DOUBLE + 1000 AS distance, 20.0::DOUBLE AS latitude, round(dbz, 4) AS reflectivity, round(vr, 4) + 0 AS velocity, round(sw, 4) AS width
    FROM r CROSS JOIN g LEFT JOIN columns c ON c.ray = r.ray AND c.gate = g.gate""")
def src24_radar_volume(spark, sf_dir):
    """Rays and gates of a radar as a netCDF volume: fields on both dimensions, angles along the rays alone."""
    gates = columns(spark, sf_dir)
    rays = _placed(gates.select("ray").distinct(), "ray")
    each = rays.withColumn("gate", F.explode(F.sequence(F.lit(1), F.lit(7))))
    rows = each.join(gates, ["ray", "gate"], "left")
    made = rows.select(
        F.col("irec").alias("itime"), (F.col("gate") - 1).alias("irange"), F.col("ray").alias("time"), (F.col("ray") * 7 % 360).alias("azimuth"), (F.col("ray") % 60).alias("elevation"), F.lit(20.0).alias("latitude"),
        F.lit(-60.0).alias("longitude"), F.lit(10.0).alias("altitude"), F.col("dbz").alias("DBZ"), F.col("vr").alias("VEL"), F.col("sw").alias("WIDTH"),
    )
    path = _file(spark, "volume.nc")
    along = {k: ["time"] for k in ("time", "azimuth", "elevation", "latitude", "longitude", "altitude")}
    netcdf.write_netcdf(made, path, {"time": rays.count(), "range": [g * 150.0 + 1000 for g in range(1, 8)]}, made.columns[2:], missing=-9999.0, doubles=True, along=along)
    told = netcdf_observations.read_observations(spark, path, "cfradial", rowsPerTask=4096)
    return rounded(told.drop("longitude", "altitude"), "second")


@registered(f"""WITH {COLUMNS}, g AS (SELECT CAST(unnest(range(1, 8)) AS INTEGER) AS gate), r AS (SELECT DISTINCT ray FROM columns)
    SELECT r.ray + 1577836800 AS second, CAST(r.ray * 7 % 360 AS DOUBLE) AS azimuth, CAST(r.ray % 60 AS DOUBLE) AS elevation, g.gate * 150.0::DOUBLE + 1000 AS distance, 20.5::DOUBLE AS latitude, -60.25::DOUBLE AS longitude, 2000.0::DOUBLE AS altitude, 1.0::DOUBLE AS beam_width,
           round(dbz, 4) AS reflectivity, round(vr, 4) + 0 AS velocity, round(sw, 4) AS width
    FROM r CROSS JOIN g LEFT JOIN columns c ON c.ray = r.ray AND c.gate = g.gate""")
def src08_sweeps(spark, sf_dir):
    """Sweeps of at most 4096 rays as DORADE files, run-length coded, read back by their rays."""
    c, ray = F.col, F.col("ray")
    rows = columns(spark, sf_dir).select(
        F.floor(ray / 4096).alias("sweep"), "ray", "gate", (ray + 1_577_836_800).alias("second"), (ray * 7 % 360).cast("double").alias("azimuth"), (ray % 60).cast("double").alias("elevation"),
        F.lit(20.5).alias("latitude"), F.lit(-60.25).alias("longitude"), F.lit(2000.0).alias("altitude"), c("dbz").alias("DZ"), c("vr").alias("VE"), c("sw").alias("SW"),
    )
    folder = new_folder(spark, "sweeps")
    dorade.write_dorade(rows, folder, "sweep", ["DZ", "VE", "SW"], [g * 150.0 + 1000 for g in range(1, 8)])
    return rounded(dorade.read_dorade(spark, folder, "DZ", "VE", "SW").drop("file", "ray", "gate"), "second")


@registered(f"""WITH {_CELLS}, b AS (SELECT *, CASE WHEN v > 0 THEN v END AS told FROM g)
    SELECT iz * 5.0::DOUBLE AS z, CAST(iy AS DOUBLE) AS y, CAST(ix AS DOUBLE) AS x, round(coalesce(told, 0), 4) AS u, round(coalesce(told * 2, 0), 4) AS v, 0.0::DOUBLE AS w, round(coalesce(told, -35), 4) AS reflectivity FROM b""")
def src34_netcdf_background(spark, sf_dir):
    """A background grid with gaps: winds are calm there, reflectivity is none."""
    v = F.when(F.col("v") > 0, F.col("v"))
    made = cells(spark, sf_dir).select(F.lit(0).alias("itime"), F.col("iz").alias("iz0"), F.col("iy").alias("iy0"), F.col("ix").alias("ix0"), v.alias("U"), (v * 2).alias("V"), F.lit(None).cast("double").alias("W"), v.alias("DBZ"))
    axes = {"time": [0.0]} | {f"{n}0": [low + step * i for i in range(many)] for n, (many, low, step) in reversed(CUBE.items())}
    path = _file(spark, "background.nc")
    netcdf.write_netcdf(made, path, axes, ["U", "V", "W", "DBZ"], attributes={"sam_i_incr": 1.0}, missing=float("nan"), doubles=True)
    return rounded(netcdf_observations.read_observations(spark, path, "fractl"), "z", "y", "x")


@registered(f"""WITH {OBS}, p AS (SELECT event_id % 400 AS column_id, z, min(event_id) AS event_id FROM obs GROUP BY ALL), a AS (SELECT column_id, z, pressure, temperature, dewpoint FROM p JOIN obs USING (event_id, z)
    ), n AS (SELECT *, lead(z) OVER w AS z1, lead(pressure) OVER w AS p1, lead(temperature) OVER w AS t1, lead(dewpoint) OVER w AS d1, row_number() OVER w AS turn FROM a WINDOW w AS (PARTITION BY column_id ORDER BY z)
    ), l AS (SELECT unnest(range(1, 60)) * 20.0::DOUBLE AS level), s AS (SELECT *, ln(pressure / level) / ln(pressure / p1) AS share FROM n JOIN l ON level > p1 AND level <= pressure)
    SELECT column_id, level, round(z + share * (z1 - z), 3) AS height, round(temperature + share * (t1 - temperature), 4) AS temperature, round(dewpoint + share * (d1 - dewpoint), 4) AS dewpoint FROM s
    UNION ALL SELECT column_id, 2013, round(z, 3), round(temperature, 4), round(dewpoint, 4) FROM n WHERE turn = 1""")
def dg08_pressure_levels(spark, sf_dir):
    """Fields on levels of constant pressure, every 20 hPa, in each column; the surface last."""
    rows = observations(spark, sf_dir).withColumn("column_id", F.col("event_id") % 400)
    one = rows.groupBy("column_id", "z").agg(F.min_by(F.struct("pressure", "temperature", "dewpoint"), "event_id").alias("f")).select("column_id", "z", "f.*")
    out = air_columns.pressure_levels(one, "column_id", "z", "pressure", ["temperature", "dewpoint"], 20.0)
    return rounded(out.withColumn("height", F.round("height", 3)), "column_id", "level", "height")


_SMOOTH = {"low": -1.0, "step": 1.0, "nodes": 11, "cutoff": 3.0}
_SMOOTH_ROWS = ", ".join(
    f"({n}, {i + 1}, {j + 1}, {float(v)!r}::DOUBLE)" for n in range(1, 8) for i, row in enumerate(air_columns.smoothing_matrix(np.arange(1.0, n + 1), **_SMOOTH)) for j, v in enumerate(row)
)


@registered(f"""WITH {COLUMNS}, m AS (SELECT * FROM (VALUES {_SMOOTH_ROWS}) t(n, i, j, m)), c AS (SELECT ray, row_number() OVER (PARTITION BY ray ORDER BY gate) AS place, vr, count(*) OVER (PARTITION BY ray) AS n FROM columns)
    SELECT ray, CAST(i AS DOUBLE) AS place, round(sum(m * vr), 4) + 0 AS vr FROM c JOIN m ON m.n = c.n AND j = place GROUP BY ray, i""")
def win07_smoothed_columns(spark, sf_dir):
    """Velocities along each ray without waves shorter than three gates."""
    rows = columns(spark, sf_dir).withColumn("place", F.row_number().over(Window.partitionBy("ray").orderBy("gate")))
    return rounded(air_columns.smoothed_columns(rows, "ray", "place", "vr", **_SMOOTH), "ray", "place")


@registered(f"""WITH {_H}, x AS (SELECT CAST(i AS BIGINT) AS col, sin(i * 0.1::DOUBLE) AS a, cos(i * 0.1::DOUBLE) AS b FROM (SELECT unnest(range(0, 441)) AS i)), s AS (SELECT row, sum(h * a) AS a, sum(h * b) AS b FROM h JOIN x USING (col) GROUP BY row)
    SELECT point, round(value / 1000, 6) AS observed, 1 / (1 + point % 3)::DOUBLE AS inverse_error, round(coalesce(a, 0), 6) + 0 AS analysis, round(coalesce(b, 0), 6) + 0 AS background FROM samples LEFT JOIN s ON row = point""")
def snk04_departures(spark, sf_dir):
    """Each observation with what analysis and background have in its place: one pass over the operator for both states, written and read back."""
    states = spark.range(441).select(F.col("id").alias("col"), F.sin(F.col("id") * 0.1).alias("analysis"), F.cos(F.col("id") * 0.1).alias("background"))
    rows = samples(spark, sf_dir).select("point", (F.col("value") / 1000).alias("observed"), (1 / (1 + F.col("point") % 3)).alias("inverse_error"))
    path = new_folder(spark, "departures")
    with solve.SparseOperator(_h(spark, sf_dir)) as op:
        seen = op.product(states, "analysis", "background")
        told = rows.join(seen, rows.point == seen.row, "left").select("point", "observed", "inverse_error", *[F.coalesce(c, F.lit(0.0)).alias(c) for c in ("analysis", "background")])
        told.write.option("sep", "\t").option("header", True).csv(path)
    back = spark.read.option("sep", "\t").option("header", True).schema(told.schema).csv(path)
    return rounded(back, "point", "inverse_error", places=6)
