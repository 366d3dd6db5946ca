"""Queries on observations: filters, frames, equations, scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import air, radar, wind
from ..operators.observations import Box, equations, in_frame, reject_reason
from .tables import GATES, OBS, SAMPLES, VAPOR, WIND, gates, observations, read, registered, rounded, samples

BOX = Box((-15.0, 15.0), (-15.0, 15.0), (0.0, 9000.0))
HOUR = 3600
_IN = "x BETWEEN -15 AND 15 AND y BETWEEN -15 AND 15 AND z BETWEEN 0 AND 9000"
_FRAMES = """spanned AS (SELECT min(second) // 3600 AS h0, max(second) // 3600 AS h1 FROM obs
), frames AS (
    SELECT h AS hour, (h - h0) % 5 * CAST(0.5 AS DOUBLE) AS fx, (h - h0) % 7 * CAST(0.25 AS DOUBLE) AS fy,
           CAST((h - h0) % 3 AS DOUBLE) AS fu, CAST((h - h0) % 4 AS DOUBLE) AS fv
    FROM spanned, LATERAL (SELECT unnest(range(h0, h1 + 1)) AS h) WHERE h % 11 <> 0
)"""


def _frames(spark, rows):
    span = rows.agg(F.floor(F.min("second") / HOUR).alias("h0"), F.floor(F.max("second") / HOUR).alias("h1"))
    hours = span.select("h0", F.explode(F.when(F.col("h0").isNotNull(), F.sequence("h0", "h1"))).alias("hour")).where(F.col("hour") % 11 != 0)
    step = F.col("hour") - F.col("h0")
    return hours.select("hour", (step % 5 * 0.5).alias("fx"), (step % 7 * 0.25).alias("fy"), (step % 3).cast("double").alias("fu"), (step % 4).cast("double").alias("fv"))


def _winds(rows):
    return rows.withColumns({"u": wind.eastward(F.col("speed"), F.col("wdir")), "v": wind.northward(F.col("speed"), F.col("wdir"))})


@registered(f"WITH {OBS} SELECT event_id, second FROM obs WHERE second >= 1704067200 AND second < 1705276800")
def flt01_time_window(spark, sf_dir):
    s = F.col("second")
    return observations(spark, sf_dir).where((s >= 1704067200) & (s < 1705276800)).select("event_id", "second")


@registered(f"WITH {OBS} SELECT event_id, x, y, z FROM obs WHERE {_IN}")
def flt04_domain_box(spark, sf_dir):
    return observations(spark, sf_dir).where(BOX.holds(F.col("x"), F.col("y"), F.col("z"))).select("event_id", "x", "y", "z")


@registered(f"""WITH {OBS}, p AS (SELECT event_id, sqrt(x * x + y * y) AS r, degrees(atan2(y, x)) AS a, z FROM obs)
    SELECT event_id, round(r, 4) + 0 AS r, round(CASE WHEN a < 0 THEN a + 360 ELSE a END, 4) + 0 AS azimuth
    FROM p WHERE r BETWEEN 2 AND 18 AND CASE WHEN a < 0 THEN a + 360 ELSE a END BETWEEN 30 AND 300 AND z BETWEEN 0 AND 9000 AND r <> 0""")
def flt05_polar_box(spark, sf_dir):
    r, a = wind.polar(F.col("x"), F.col("y"))
    rows = observations(spark, sf_dir).withColumns({"r": r, "azimuth": a})
    rows = rows.where(F.col("r").between(2, 18) & F.col("azimuth").between(30, 300) & F.col("z").between(0, 9000) & (F.col("r") != 0))
    return rounded(rows.select("event_id", "r", "azimuth"), "event_id")


@registered(f"""WITH {OBS} SELECT coalesce(CASE WHEN NOT (second >= 1704067200 AND second < 1705276800) THEN 'time'
        WHEN NOT ({_IN}) THEN 'domain' END, 'kept') AS reason, count(*) AS n FROM obs GROUP BY 1""")
def flt16_reject_counts(spark, sf_dir):
    c = F.col
    why = reject_reason(c("second"), 1704067200, 1705276800, c("x"), c("y"), c("z"), BOX)
    return observations(spark, sf_dir).groupBy(F.coalesce(why, F.lit("kept")).alias("reason")).agg(F.count("*").alias("n"))


@registered(f"WITH {GATES} SELECT ray, gate, vr FROM gates WHERE dbz IS NOT NULL AND elevation <= 45 AND ray % 3 = 0")
def flt14_ray_sampling(spark, sf_dir):
    return gates(spark, sf_dir).where((F.col("ray") % 3 == 0) & F.col("dbz").isNotNull() & (F.col("elevation") <= 45)).select("ray", "gate", "vr")


@registered(f"""WITH {OBS}, {_FRAMES}
    SELECT event_id, hour, round(x - fx, 4) + 0 AS x, round(y - fy, 4) + 0 AS y FROM obs JOIN frames ON hour = second // 3600""")
def jn01_moving_frame(spark, sf_dir):
    rows = observations(spark, sf_dir).withColumn("hour", F.floor(F.col("second") / HOUR))
    rows = in_frame(rows, _frames(spark, rows), "hour")
    return rounded(rows.select("event_id", "hour", (F.col("x") - F.col("fx")).alias("x"), (F.col("y") - F.col("fy")).alias("y")), "event_id", "hour")


@registered(f"""WITH {OBS}, {_FRAMES}, w AS (
        SELECT event_id, x - fx AS x, y - fy AS y, z, temperature, pressure, {VAPOR} AS e, {WIND.replace("AS u", "- fu AS u").replace("AS v", "- fv AS v")}
        FROM obs JOIN frames ON hour = second // 3600
    ), d AS (
        SELECT *, (pressure - e) * 100 / (287 * temperature) AS dry, 622 * e / (pressure - e) AS q FROM w WHERE x BETWEEN -15 AND 15 AND y BETWEEN -15 AND 15 AND z BETWEEN 0 AND 9000
    ), m AS (SELECT *, dry * (1 + q / 1000) AS rho FROM d), eq AS (
        SELECT event_id, 0 AS variable, rho * u AS value, 1 / 1.5::DOUBLE AS inverse_error FROM m
        UNION ALL SELECT event_id, 1, rho * v, 1 / 1.5::DOUBLE FROM m
        UNION ALL SELECT event_id, 3, temperature - (300 - 0.0065::DOUBLE * z), 1 / 1.2::DOUBLE FROM m
        UNION ALL SELECT event_id, 4, 0.5 * ((q + 1e-7) - 1e-14 / (q + 1e-7)) - 5, 1 / 0.5::DOUBLE FROM m
        UNION ALL SELECT event_id, 5, (dry - 1.2::DOUBLE * exp(-z / 9000)) * 100, 1 / 0.01::DOUBLE FROM m)
    SELECT event_id, CAST(variable AS INTEGER) AS variable, round(value, 4) + 0 AS value, round(inverse_error, 4) AS inverse_error FROM eq WHERE value IS NOT NULL""")
def prj03_insitu_equations(spark, sf_dir):
    rows = observations(spark, sf_dir).withColumn("hour", F.floor(F.col("second") / HOUR))
    rows = _winds(in_frame(rows, _frames(spark, rows), "hour"))
    c, e = F.col, air.vapor_pressure(F.col("dewpoint"))
    rows = rows.withColumns({"x": c("x") - c("fx"), "y": c("y") - c("fy"), "u": c("u") - c("fu"), "v": c("v") - c("fv")}).where(BOX.holds(c("x"), c("y"), c("z")))
    rows = rows.withColumns({
        "w": F.lit(None).cast("double"), "ratio": air.mixing_ratio(e, c("pressure")), "dry": air.dry_density(c("pressure") - e, c("temperature")),
        "density": air.moist_density(c("pressure"), c("temperature"), c("dewpoint")), "t_ref": 300 - 0.0065 * c("z"), "q_ref": F.lit(5.0), "dry_ref": 1.2 * F.exp(-c("z") / 9000),
    })
    errors = {"wind": 1.5, "w": 1.5, "temperature": 1.2, "ratio": 0.5, "density": 0.01}
    return rounded(equations(rows, errors, ("event_id",)), "event_id", "variable")


@registered(f"""WITH {OBS}, w AS (SELECT event_id, x, y, {WIND} FROM obs)
    SELECT event_id, round(u, 4) + 0 AS u, round(v, 4) + 0 AS v,
           round(CASE WHEN x * x + y * y > 0 THEN (u * x + v * y) / sqrt(x * x + y * y) END, 4) + 0 AS radial,
           round(CASE WHEN x * x + y * y > 0 THEN (v * x - u * y) / sqrt(x * x + y * y) END, 4) + 0 AS tangential FROM w""")
def fn15_wind_components(spark, sf_dir):
    rows = _winds(observations(spark, sf_dir))
    radial, tangential = wind.around(F.col("u"), F.col("v"), F.col("x"), F.col("y"))
    return rounded(rows.select("event_id", "u", "v", radial.alias("radial"), tangential.alias("tangential")), "event_id")


@registered(f"""WITH {OBS}, p AS (SELECT event_id, x + 20 AS lat FROM obs)
    SELECT event_id, round(111.13209 - 0.56605 * cos(2 * radians(lat)) + 0.00012 * cos(4 * radians(lat)) - 0.000002 * cos(6 * radians(lat)), 4) AS north,
           round(111.41513 * cos(radians(lat)) - 0.09455 * cos(3 * radians(lat)) + 0.00012 * cos(5 * radians(lat)), 4) AS east FROM p""")
def fn12_km_per_degree(spark, sf_dir):
    north, east = wind.km_per_degree(F.col("x") + 20)
    return rounded(observations(spark, sf_dir).select("event_id", north.alias("north"), east.alias("east")), "event_id")


@registered(f"""WITH {OBS}, a AS (
        SELECT *, {VAPOR} AS e, 6.112::DOUBLE * exp(17.62::DOUBLE * (temperature - 273.15::DOUBLE) / (243.12::DOUBLE + temperature - 273.15::DOUBLE)) AS s,
               6.1078::DOUBLE * exp(5.0065::DOUBLE * ln(273.15::DOUBLE / temperature)) * exp((5.0065::DOUBLE + 19.83923::DOUBLE) * (1 - 273.15::DOUBLE / temperature)) AS g FROM obs
    ), b AS (SELECT *, 622 * e / (pressure - e) AS q, 622 * s / (pressure - s) AS qs, (pressure - e) * 100 / (287 * temperature) AS dry FROM a)
    SELECT event_id, round(e, 4) AS vapor, round(s, 4) AS saturated, round(q, 4) AS ratio, round(qs, 4) AS ratio_saturated, round(dry, 4) AS dry,
           round(dry * (1 + q / 1000), 4) AS moist, round(temperature / (1 - g / pressure * (1 - 0.622::DOUBLE)), 4) AS virtual,
           round(1005.7::DOUBLE * temperature + 1e3 * (2.501::DOUBLE - 0.00237::DOUBLE * (temperature - 273.15::DOUBLE)) * q + 9.81::DOUBLE * z, 2) AS energy FROM b""")
def fn21_moist_air(spark, sf_dir):
    c = F.col
    e, s = air.vapor_pressure(c("dewpoint")), air.saturation_pressure(c("temperature"))
    q = air.mixing_ratio(e, c("pressure"))
    rows = observations(spark, sf_dir).select(
        "event_id", e.alias("vapor"), s.alias("saturated"), q.alias("ratio"), air.mixing_ratio(s, c("pressure")).alias("ratio_saturated"),
        air.dry_density(c("pressure") - e, c("temperature")).alias("dry"), air.moist_density(c("pressure"), c("temperature"), c("dewpoint")).alias("moist"),
        air.virtual_temperature(c("temperature"), c("pressure")).alias("virtual"), F.round(air.static_energy(c("temperature"), q, c("z")), 2).alias("energy"),
    )
    return rounded(rows, "event_id", "energy")


@registered(f"""WITH {OBS}, h AS (SELECT event_id, temperature, CAST(event_id % 120 AS DOUBLE) AS humidity FROM obs), s AS (
        SELECT *, ln(exp(5.0065::DOUBLE * ln(273.15::DOUBLE / temperature)) * exp(24.84573::DOUBLE * (1 - 273.15::DOUBLE / temperature)) * CASE WHEN humidity > 0 THEN humidity END / 100) AS u FROM h)
    SELECT event_id, round(CASE WHEN humidity > 0 AND humidity < 101 THEN 237.3::DOUBLE * u / (17.2694::DOUBLE - u) + 273.15::DOUBLE END, 4) AS dewpoint FROM s""")
def fn24_dewpoint_of_humidity(spark, sf_dir):
    humid = (F.col("event_id") % 120).cast("double")
    return rounded(observations(spark, sf_dir).select("event_id", air.dewpoint_of_humidity(humid, F.col("temperature")).alias("dewpoint")), "event_id")


@registered(f"""WITH {SAMPLES}, q AS (SELECT point, value / 100 - 5 AS q FROM samples), b AS (SELECT point, 0.5 * ((q + 1e-7) - 1e-14 / (q + 1e-7)) AS b FROM q)
    SELECT point, round(b, 4) AS widened, round(CASE WHEN b > 0 THEN sqrt(b * b + 1e-14) + b - 1e-7 ELSE 1e-6 END, 4) AS narrowed FROM b""")
def fn20_biased_transform(spark, sf_dir):
    rows = samples(spark, sf_dir).select("point", air.widen(F.col("value") / 100 - 5).alias("widened"))
    return rounded(rows.withColumn("narrowed", air.narrow(F.col("widened"))), "point")


_FALL = """z AS (
        SELECT ray, gate, dbz, pow(10, dbz * 0.1::DOUBLE) AS zz, CAST(gate * 1000 AS DOUBLE) AS h, pow(1 + gate / 10.0::DOUBLE, 0.45::DOUBLE) AS thin FROM gates WHERE dbz IS NOT NULL
    )"""


def _blend(rain, ice):
    share = "(dbz - 20) / 10"
    mixed = f"CASE WHEN dbz > 20 AND dbz <= 30 THEN {rain} * {share} + {ice} * (1 - {share}) WHEN dbz > 30 THEN {rain} ELSE {ice} END"
    return f"CASE WHEN h < 3500 THEN {rain} WHEN h > 4500 THEN {mixed} ELSE {rain} * (4500 - h) / 1000 + ({mixed}) * (h - 3500) / 1000 END"


@registered(f"""WITH {GATES}, {_FALL}, w AS (SELECT *, -thin * 0.817::DOUBLE * pow(zz, 0.063::DOUBLE) AS snow, -thin * 2.6::DOUBLE * pow(zz, 0.107::DOUBLE) AS rain FROM z)
    SELECT ray, gate, round({_blend("rain", "snow")}, 4) AS fall_speed FROM w""")
def fn17_fall_speed(spark, sf_dir):
    c = F.col
    speed = radar.fall_speed(c("dbz"), c("gate") * 1000.0, 1 + c("gate") / 10.0, freezing=3500.0)
    return rounded(gates(spark, sf_dir).where("dbz IS NOT NULL").select("ray", "gate", speed.alias("fall_speed")), "ray", "gate")


@registered(f"""WITH {GATES}, {_FALL}, w AS (SELECT *, pow(zz / 670, 0.5587::DOUBLE) AS ice, pow(zz / 14630, 0.6905::DOUBLE) AS rain FROM z)
    SELECT ray, gate, round({_blend("rain", "ice")}, 4) AS content FROM w""")
def fn18_water_content(spark, sf_dir):
    content = radar.water_content(F.col("dbz"), F.col("gate") * 1000.0, freezing=3500.0)
    return rounded(gates(spark, sf_dir).where("dbz IS NOT NULL").select("ray", "gate", content.alias("content")), "ray", "gate")


@registered(f"""WITH {GATES} SELECT ray, gate, round(pow(10, dbz * 0.1::DOUBLE), 3) AS z, round((dbz + 35) * 0.1::DOUBLE, 4) AS stored,
        round(sqrt(distance * distance + 6371000.0::DOUBLE * 6371000 + 2 * distance * 6371000 * sin(radians(elevation))) - 6371000, 3) AS height FROM gates""")
def fn14_gate_height(spark, sf_dir):
    rows = gates(spark, sf_dir)
    c = F.col
    return rows.select("ray", "gate", F.round(radar.linear(c("dbz")), 3).alias("z"), F.round((c("dbz") + 35) * 0.1, 4).alias("stored"), F.round(radar.beam_height(c("distance"), c("elevation")), 3).alias("height"))


@registered(f"""WITH {GATES} SELECT ray, gate, round(sin(radians(azimuth)) * cos(radians(elevation)), 6) + 0 AS wu, round(cos(radians(azimuth)) * cos(radians(elevation)), 6) + 0 AS wv,
        round(sin(radians(elevation)), 6) + 0 AS ww, round(vr - 3 * sin(radians(azimuth)) * cos(radians(elevation)) + 2 * cos(radians(azimuth)) * cos(radians(elevation)), 4) + 0 AS value,
        round(greatest(abs(sin(radians(elevation))) * 2 + sw * 1, 1), 4) AS error FROM gates WHERE elevation <= 45""")
def prj11_radar_equations(spark, sf_dir):
    rows = gates(spark, sf_dir).where("elevation <= 45")
    wu, wv, ww = radar.doppler_weights(F.col("azimuth"), F.col("elevation"))
    value, error = F.col("vr") - 3 * wu + 2 * wv, F.greatest(F.abs(ww) * 2 + F.col("sw"), F.lit(1.0))
    six = [(F.round(c, 6) + 0.0).alias(n) for c, n in ((wu, "wu"), (wv, "wv"), (ww, "ww"))]
    return rows.select("ray", "gate", *six, (F.round(value, 4) + 0.0).alias("value"), F.round(error, 4).alias("error"))


@registered(f"""WITH {OBS}, a AS (SELECT event_id, temperature AS t, 0.5::DOUBLE + event_id % 12 AS q, 1.2::DOUBLE * exp(-z / 9000) AS rho FROM obs), b AS (
        SELECT *, t * rho * q / 1000 * 4.61::DOUBLE AS vp, t * rho * 2.87::DOUBLE AS dry, exp(-6096.9385::DOUBLE / t + 16.635794::DOUBLE - 2.711193e-2 * t + 1.673952e-5 * t * t + 2.433502::DOUBLE * ln(t)) AS sv FROM a
    ), c AS (SELECT *, dry + vp AS p, 622 * sv / dry AS qs, t * pow(1000 / (dry + vp), 0.2854::DOUBLE * (1 - 0.00028::DOUBLE * q)) AS theta, ln(least(vp, sv) / 6.1078::DOUBLE) AS le FROM b)
    SELECT event_id, round(p, 3) AS pressure, round(theta, 3) AS theta,
           round(theta * exp((3.376::DOUBLE / (2840 / (3.5::DOUBLE * ln(t) - ln(vp) - 4.805::DOUBLE) + 55) - 0.00254::DOUBLE) * q * (1 + 0.00081::DOUBLE * q)), 3) AS theta_e,
           round(theta * exp((3.376::DOUBLE / (2840 / (3.5::DOUBLE * ln(t) - ln(sv) - 4.805::DOUBLE) + 55) - 0.00254::DOUBLE) * qs * (1 + 0.00081::DOUBLE * qs)), 3) AS theta_es,
           round(least(100 * vp / sv, 100), 3) AS humidity, round(237.3::DOUBLE * le / (17.2694::DOUBLE - le) + 273.15::DOUBLE, 3) AS dewpoint FROM c""")
def fn27_analysis_air(spark, sf_dir):
    made = air.analysed(F.col("temperature"), 0.5 + (F.col("event_id") % 12).cast("double"), 1.2 * F.exp(-F.col("z") / 9000))
    return rounded(observations(spark, sf_dir).select("event_id", *[c.alias(n) for n, c in made.items()]), "event_id", places=3)


@registered(f"""WITH {OBS} SELECT event_id, CAST(second % 86400 AS BIGINT) AS second_of_day, strftime(make_timestamp(second * 1000000), '%Y-%m-%d') AS day FROM obs""")
def fn07_time_parts(spark, sf_dir):
    s = F.col("second")
    return observations(spark, sf_dir).select("event_id", (s % 86400).alias("second_of_day"), F.date_format(F.timestamp_seconds(s), "yyyy-MM-dd").alias("day"))


@registered("SELECT p_partkey AS point, CAST(len(list_filter(string_split(p_name, ' '), lambda x: x <> '')) AS INTEGER) AS parts, list_filter(string_split(p_name, ' '), lambda x: x <> '')[1] AS first_part FROM part")
def fn01_split(spark, sf_dir):
    parts = F.filter(F.split("p_name", " "), lambda x: x != "")
    return read(spark, sf_dir, "part").select(F.col("p_partkey").alias("point"), F.size(parts).alias("parts"), F.try_element_at(parts, F.lit(1)).alias("first_part"))


@registered(f"""WITH {OBS} SELECT 'wind' AS kind, event_id AS id, round(speed, 4) AS value FROM obs WHERE speed IS NOT NULL
    UNION ALL SELECT 'gate', l_orderkey * 10 + l_linenumber, round(l_discount * 100 - 5, 4) FROM lineitem""")
def set01_union_all(spark, sf_dir):
    a = observations(spark, sf_dir).where("speed IS NOT NULL").select(F.lit("wind").alias("kind"), F.col("event_id").alias("id"), F.round("speed", 4).alias("value"))
    b = gates(spark, sf_dir).select(F.lit("gate").alias("kind"), (F.col("ray") * 10 + F.col("gate")).alias("id"), F.round("vr", 4).alias("value"))
    return a.unionByName(b)
