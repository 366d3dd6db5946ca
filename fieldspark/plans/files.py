"""Queries on text files: lines made from events are written, read back by their kind's reader, and compared."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import profile
from ..sources import flights, text
from ..sources.place import new_folder
from .tables import COLUMNS, OBS, columns, gates, observations, registered, rounded

_FLOWN = f"""WITH {OBS}, flown AS (
    SELECT event_id, second, second // 86400 * 86400 AS day, 20 + x AS latitude, y - 60 AS longitude, z AS altitude, round(pressure, 1) AS pressure, round(temperature - 273.15::DOUBLE, 1) AS t,
           round(dewpoint - 273.15::DOUBLE, 1) AS td, round(speed, 2) AS speed, wdir AS direction FROM obs)"""
_K = "round({} + 273.15::DOUBLE, 4)"


def _flown(spark, sf_dir):
    c = F.col
    return observations(spark, sf_dir).select(
        "event_id", "second", (F.floor(c("second") / 86400) * 86400).alias("day"), (20 + c("x")).alias("latitude"), (c("y") - 60).alias("longitude"), c("z").alias("altitude"), F.round("pressure", 1).alias("pressure"),
        F.round(c("temperature") - 273.15, 1).alias("t"), F.round(c("dewpoint") - 273.15, 1).alias("td"), F.round("speed", 2).alias("speed"), c("wdir").alias("direction"),
    )


def _shown(name: str, places: int = 2, missing: str = "-999"):
    return F.coalesce(F.col(name).cast(f"decimal(12,{places})").cast("string"), F.lit(missing))


def _there_and_back(spark, rows, kind: str, header, *fields):
    """A file for each day: its header and lines are written, then read as a kind."""
    path, name = new_folder(spark, f"flights-{kind}"), F.concat(F.lit("d"), "day").alias("name")
    data = rows.select(name, F.col("event_id").alias("number"), F.concat_ws(" ", *fields).alias("value"))
    heads = rows.select("day").distinct().select(name, F.posexplode(F.split(header, "\n")).alias("place", "value"))
    heads = heads.select("name", (F.col("place") - 1000).cast("long").alias("number"), "value")
    flights.write_flights(heads.unionByName(data), path)
    return flights.read_flights(spark, path, kind)


def _told(rows, *plain):
    names = [c for c in rows.columns if c not in ("second", *plain)]
    return rows.select("second", *plain, *[(F.round(c, 4) + 0.0).alias(c) for c in names])


@registered(_FLOWN + f""", h AS (SELECT *, {_K.format('t')} AS temperature, CAST(event_id % 90 + 5 AS DOUBLE) AS rh FROM flown), s AS (
        SELECT *, ln(exp(5.0065::DOUBLE * ln(273.15::DOUBLE / temperature)) * exp(24.84573::DOUBLE * (1 - 273.15::DOUBLE / temperature)) * rh / 100) AS u FROM h)
    SELECT second, latitude, longitude, altitude, pressure, temperature, round(237.3::DOUBLE * u / (17.2694::DOUBLE - u) + 273.15::DOUBLE, 4) AS dewpoint, direction, speed FROM s""")
def src05_sondes(spark, sf_dir):
    """Soundings with fixed columns in the header and a line of dashes before the data."""
    rows = _flown(spark, sf_dir)
    at = F.from_unixtime("day")
    header = F.concat(F.lit("Launch Site Type/Site ID:  sonde\n"), F.rpad(F.lit("UTC Launch Time (y,m,d,h,m,s):"), 43, " "), F.date_format(at, "yyyy, MM, dd"), F.lit(", "), F.date_format(at, "HH:mm:ss"), F.lit("\n------"))
    made = [(F.col("second") - F.col("day")).cast("string"), F.lit("0"), F.lit("0"), F.lit("0"), _shown("pressure"), _shown("t"), F.lit("0"), (F.col("event_id") % 90 + 5).cast("string"), F.lit("0"), F.lit("0"), _shown("speed"), _shown("direction"), F.lit("0"), _shown("altitude"), _shown("longitude"), _shown("latitude")]
    return _told(_there_and_back(spark, rows, "eol", header, *made))


@registered(_FLOWN + f""" SELECT second, latitude, longitude, altitude, pressure, {_K.format('t')} AS temperature, {_K.format('td')} AS dewpoint,
    CASE WHEN speed >= 0 THEN direction END AS direction, CASE WHEN speed >= 0 THEN speed END AS speed, CASE WHEN event_id % 5 <> 0 THEN CAST(event_id % 7 AS DOUBLE) END AS w FROM flown""")
def src06_flight_level(spark, sf_dir):
    """Flight-level files: the date in the first of four header lines, longitudes west."""
    rows = _flown(spark, sf_dir)
    header = F.concat(F.lit("Flight "), F.date_format(F.from_unixtime("day"), "yyyyMMdd"), F.lit("H1\ntwo\nthree\nfour"))
    w = F.when(F.col("event_id") % 5 != 0, (F.col("event_id") % 7).cast("string")).otherwise("-32767")
    clock = F.date_format(F.from_unixtime("second"), "HHmmss")
    west = (-F.col("longitude")).cast("decimal(12,2)").cast("string")
    made = [clock, _shown("latitude"), west, F.lit("0"), F.lit("0"), F.lit("0"), F.lit("0"), _shown("altitude"), _shown("pressure"), _shown("direction"), _shown("speed"), _shown("t"), _shown("td"), F.lit("0"), F.lit("0"), F.lit("0"), w]
    return _told(_there_and_back(spark, rows, "1sec", header, *made))


@registered(_FLOWN + f""", {profile.sql(40_000)}, lp AS (
        SELECT metre, 1000 * pow(exner, 1005.7::DOUBLE / 287.04::DOUBLE) * (1 + (sqrt(b * b + 1e-14) + b - 1e-7) / 1000 / 0.622::DOUBLE) AS p FROM prof WHERE theta_1 IS NOT NULL AND metre < 39999
    ), ld AS (SELECT metre, p, lead(p) OVER (ORDER BY metre) AS p_1 FROM lp)
    SELECT second // 60 * 60 AS second, latitude, longitude, pressure, coalesce(speed, -999) AS speed, direction, round(metre + (ln(p) - ln(pressure)) / (ln(p) - ln(p_1)), 2) AS height
    FROM flown LEFT JOIN ld ON pressure <= p AND pressure > p_1""")
def src13_satellite_winds(spark, sf_dir):
    """Winds from satellites: their height is where the reference air has their pressure."""
    clock = F.date_format(F.from_unixtime("second"), "yyyyMMdd HHmm")
    west = (-F.col("longitude")).cast("decimal(12,2)").cast("string")
    back = _there_and_back(spark, _flown(spark, sf_dir), "cimss", F.lit("type sat day hms lat lon pre spd dir"), F.lit("IR G16"), clock, _shown("latitude"), west, _shown("pressure"), _shown("speed"), _shown("direction"))
    table = profile.metres(profile.sounding(spark)).where("metre < 39999")
    placed = profile.height_of_pressure(back, table).withColumn("height", F.round("height", 2))
    return _told(placed, "height")


@registered(_FLOWN + f""", c AS (SELECT *, CAST(floor(abs(latitude)) AS INTEGER) AS la, CAST(floor(abs(longitude)) AS INTEGER) AS lo, event_id % 60 AS m FROM flown)
    SELECT second, round(la + m / 60.0::DOUBLE, 4) AS latitude, round(-(lo + m / 60.0::DOUBLE), 4) AS longitude, altitude,
           round(CASE WHEN pressure >= 100 THEN pressure END, 4) AS pressure, {_K.format('t')} AS temperature, {_K.format('td')} AS dewpoint, direction, round(event_id % 150 * 0.514::DOUBLE, 4) AS speed FROM c""")
def src27_recon(spark, sf_dir):
    """Coded reconnaissance messages: degrees and minutes with a hemisphere, tenths, knots, slashes for what is missing."""
    c, m = F.col, F.col("event_id") % 60
    rows = _flown(spark, sf_dir)
    lat = F.format_string("%02d%02dN", F.floor(F.abs("latitude")).cast("int"), m.cast("int"))
    lon = F.format_string("%03d%02dW", F.floor(F.abs("longitude")).cast("int"), m.cast("int"))
    tenths = F.round(c("pressure") * 10).cast("int")
    p = F.when(c("pressure") >= 100, F.format_string("%04d", tenths % 10000)).otherwise("////")

    def signed(name):
        return F.coalesce(F.format_string("%+04d", F.round(c(name) * 10).cast("int")), F.lit("////"))

    td = F.when(c("td").isNull(), "////").otherwise(signed("td"))
    made = [F.date_format(F.from_unixtime("second"), "HHmmss"), lat, lon, p, c("altitude").cast("int").cast("string"), F.lit("////"), signed("t"), td, F.format_string("%03d020", c("direction").cast("int")), F.format_string("%03d", (c("event_id") % 150).cast("int")), F.lit("///"), F.lit("000"), F.lit("00")]
    header = F.concat(F.lit("AF300 01HHA STORM HDOB 01 "), F.date_format(F.from_unixtime("day"), "yyyyMMdd"))
    return _told(_there_and_back(spark, rows, "hdob", header, *made))


def _round_trip(spark, rows, kind: str, *fields):
    path = new_folder(spark, f"lines-{kind}")
    rows.select(F.concat_ws(" ", *fields).alias("value")).write.text(path)
    return text.read_text(spark, path, kind)


@registered(_FLOWN + f" SELECT second, latitude, longitude, altitude, pressure, {_K.format('t')} AS temperature, {_K.format('td')} AS dewpoint, direction, speed, CAST(event_id % 7 AS DOUBLE) AS w FROM flown")
def src15_insitu(spark, sf_dir):
    w = (F.col("event_id") % 7).cast("string")
    fields = [F.date_format(F.from_unixtime("second"), "yyyy-MM-dd'T'HH:mm:ss"), *[_shown(n) for n in ("latitude", "longitude", "altitude", "pressure", "t", "td", "direction", "speed")], w]
    return _told(_round_trip(spark, _flown(spark, sf_dir), "insitu", *fields))


@registered(_FLOWN + """ SELECT second, latitude, longitude, altitude, CAST(event_id % 30 AS DOUBLE) AS u, CAST(event_id % 20 AS DOUBLE) AS v, CAST(event_id % 7 AS DOUBLE) AS w, t AS temperature,
    CAST(event_id % 18 AS DOUBLE) AS mixing_ratio, CAST(event_id % 3 AS DOUBLE) AS dry_density, speed AS moist_density, pressure AS reflectivity FROM flown""")
def src18_model_samples(spark, sf_dir):
    i = F.col("event_id")
    fields = [F.date_format(F.from_unixtime("second"), "yyyy-MM-dd_HH:mm:ss"), _shown("latitude"), _shown("longitude"), _shown("altitude"), *[(i % k).cast("string") for k in (30, 20, 7)], _shown("t"), (i % 18).cast("string"), (i % 3).cast("string"), _shown("speed"), _shown("pressure")]
    return _told(_round_trip(spark, _flown(spark, sf_dir), "model", *fields))


@registered(_FLOWN + """ SELECT second, latitude, longitude, altitude, CAST(event_id % 30 AS DOUBLE) AS u, CAST(event_id % 20 AS DOUBLE) AS v, CAST(event_id % 7 AS DOUBLE) AS w, t AS temperature,
    CAST(event_id % 18 AS DOUBLE) AS mixing_ratio, CAST(event_id % 3 AS DOUBLE) AS dry_density, speed AS reflectivity, CAST(event_id % 400 AS DOUBLE) AS terrain FROM flown""")
def src32_background(spark, sf_dir):
    """The background: twelve columns, the last the terrain's height."""
    i = F.col("event_id")
    fields = [F.date_format(F.from_unixtime("second"), "yyyy-MM-dd_HH:mm:ss"), _shown("latitude"), _shown("longitude"), _shown("altitude"), *[(i % k).cast("string") for k in (30, 20, 7)], _shown("t"), (i % 18).cast("string"), (i % 3).cast("string"), _shown("speed"), (i % 400).cast("string")]
    return _told(_round_trip(spark, _flown(spark, sf_dir), "background", *fields))


@registered("SELECT CAST(p_partkey % 7 AS INTEGER) AS variable, CAST(p_partkey AS INTEGER) AS i, CAST(p_size AS INTEGER) AS j, CAST(p_partkey % 40 AS INTEGER) AS k, round(p_retailprice, 2) AS background FROM part")
def src37_coefficients(spark, sf_dir):
    """Coefficients as written after an analysis: the lines of names between them are skipped, the fifth column counts."""
    key = F.col("p_partkey")
    rows = spark.read.parquet(f"{sf_dir}/part.parquet")
    path = new_folder(spark, "coefficients")
    lines = [(key % 7).cast("string"), key.cast("string"), F.col("p_size").cast("string"), (key % 40).cast("string"), F.col("p_retailprice").cast("decimal(12,2)").cast("string"), F.lit("0.5"), F.lit("-0.5")]
    each = F.when(key % 100 == 0, F.array(F.lit("Variable I J K Background Analysis Increment"), F.concat_ws("\t", *lines))).otherwise(F.array(F.concat_ws("\t", *lines)))
    rows.select(F.explode(each).alias("value")).write.text(path)
    return text.read_text(spark, path, "coefficients").select("variable", "i", "j", "k", F.round("background", 2).alias("background"))


@registered("SELECT CAST(p_partkey % 100 AS DOUBLE) AS x, CAST(p_size AS DOUBLE) AS y, round(p_retailprice, 2) AS height FROM part")
def src39_terrain(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/part.parquet")
    path = new_folder(spark, "terrain")
    rows.select(F.concat_ws(",", (F.col("p_partkey") % 100).cast("string"), F.col("p_size").cast("string"), F.col("p_retailprice").cast("decimal(12,2)").cast("string")).alias("value")).write.text(path)
    return text.read_text(spark, path, "terrain").select("x", "y", F.round("height", 2).alias("height"))


@registered("SELECT p_size * 400.0::DOUBLE AS z, round(298 + p_size * 1.5::DOUBLE + count(*) % 7 / 10.0::DOUBLE, 2) AS theta, round(18 - p_size * 0.3::DOUBLE, 2) AS q FROM part GROUP BY p_size")
def src38_sounding(spark, sf_dir):
    """A reference sounding as text: a level for each size of part, warmer and drier upwards."""
    size = F.col("p_size")
    levels = spark.read.parquet(f"{sf_dir}/part.parquet").groupBy("p_size").agg(F.count("*").alias("n"))
    levels = levels.select((size * 400.0).alias("z"), F.round(298 + size * 1.5 + F.col("n") % 7 / 10, 2).alias("theta"), F.round(18 - size * 0.3, 2).alias("q"))
    path = new_folder(spark, "sounding")
    levels.select(F.concat_ws(" ", "z", "theta", "q", F.lit("0 0")).alias("value")).write.text(path)
    return text.read_text(spark, path, "sounding").select("z", "theta", "q")


@registered(f"""WITH {COLUMNS}, g AS (SELECT CAST(unnest(range(1, 24)) AS INTEGER) AS gate), r AS (SELECT DISTINCT ray FROM columns)
    SELECT r.ray AS second, CAST(90 - r.ray % 360 AS DOUBLE) AS azimuth, CAST(r.ray % 60 AS DOUBLE) AS elevation, g.gate * 150.0::DOUBLE + 1000 AS distance, 20.5::DOUBLE AS latitude, -60.25::DOUBLE AS longitude, 3000.0::DOUBLE AS altitude,
           10.0::DOUBLE AS reflectivity, round(coalesce(round(vr * 10), g.gate) / 10, 4) + 0 AS velocity
    FROM r CROSS JOIN g LEFT JOIN columns c ON c.ray = r.ray AND c.gate = g.gate WHERE g.gate % 9 <> 8""")
def src26_radials(spark, sf_dir):
    """Radials of 23 gates on three lines each, in files of 16 384 rays; the eighth gate of nine is missing."""
    held = columns(spark, sf_dir).groupBy("ray").agg(F.map_from_entries(F.collect_list(F.struct("gate", (F.round(F.col("vr") * 10)).alias("v")))).alias("m"))

    def told(gate):
        value = F.coalesce(F.try_element_at("m", F.lit(gate)), F.lit(float(gate))).cast("int")
        return F.lit("-8888") if gate % 9 == 8 else value.cast("string")

    ray = F.concat_ws(" ", F.col("ray").cast("string"), F.lit("20.5 -60.25 3000"), (F.col("ray") % 360).cast("string"), (F.col("ray") % 60).cast("string"))
    each = [ray, *[F.concat_ws(" ", *[told(g) for g in range(a, min(a + 10, 24))]) for a in (1, 11, 21)]]
    # a file is written by one task: their number grows with the rays
    name = F.concat(F.lit("r"), F.floor(F.col("ray") / 16384).cast("string")).alias("name")
    data = held.select(name, F.posexplode(F.array(*each)).alias("place", "value"), "ray").select("name", (F.col("ray") * 4 + F.col("place")).alias("number"), "value")
    header = F.array(*[F.lit(x) for x in ("20200101", "42RF", "01", "23", "1000", "150", "0", "0")])
    heads = gates(spark, sf_dir).select(name).distinct().select("name", F.posexplode(header).alias("place", "value"))
    path = new_folder(spark, "radials")
    flights.write_flights(heads.select("name", (F.col("place") - 1000).cast("long").alias("number"), "value").unionByName(data), path)
    return rounded(flights.read_radials(spark, path), "second")
