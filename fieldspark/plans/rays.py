"""Queries on coded rays, airborne geometry, further moist air, and text sinks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import air, profile, radar, wind
from ..operators import runs
from ..sources import flights, text
from ..sources.place import new_folder
from .profiles import _REF, _referenced
from .tables import COLUMNS, OBS, SAMPLES, VAPOR, WIND, columns, observations, registered, rounded, samples


@registered(f"WITH {OBS}, c AS (SELECT event_id, CAST(floor(abs(x)) AS INTEGER) AS d, event_id % 60 AS m, event_id % 2 AS h FROM obs) SELECT event_id, round((d + m / 60.0::DOUBLE) * CASE WHEN h = 1 THEN -1 ELSE 1 END, 6) + 0 AS latitude FROM c")
def fn03_hemispheres(spark, sf_dir):
    i = F.col("event_id")
    coded = F.format_string("%02d%02d%s", F.floor(F.abs("x")).cast("int"), (i % 60).cast("int"), F.when(i % 2 == 1, "S").otherwise("N"))
    return rounded(observations(spark, sf_dir).select("event_id", flights.degrees_of(coded, 2, "S").alias("latitude")), "event_id", places=6)


@registered(f"""WITH {OBS} SELECT event_id, epoch_us(make_timestamp(2000 + event_id % 25, 1, 1, 0, 0, 0)) // 1000000 + (event_id % 366) * 86400 + second % 86400 AS ray_second FROM obs""")
def fn08_ray_times(spark, sf_dir):
    """Year, day of the year and clock, as rays carry them."""
    i = F.col("event_id")
    day = F.date_add(F.make_date(2000 + (i % 25).cast("int"), F.lit(1), F.lit(1)), (i % 366).cast("int"))
    return observations(spark, sf_dir).select("event_id", (F.unix_seconds(day.cast("timestamp")) + F.col("second") % 86400).alias("ray_second"))


@registered(f"""WITH {OBS}, a AS (SELECT *, {VAPOR} AS e, 6.112::DOUBLE * exp(17.62::DOUBLE * (temperature - 273.15::DOUBLE) / (243.12::DOUBLE + temperature - 273.15::DOUBLE)) AS s, {WIND} FROM obs
    ), b AS (SELECT *, 622 * e / (pressure - e) AS q, 622 * s / (pressure - s) AS qs, 1e3 * (2.501::DOUBLE - 0.00237::DOUBLE * (temperature - 273.15::DOUBLE)) AS l, 1005.7::DOUBLE * temperature + 9.81::DOUBLE * z AS plain FROM a)
    SELECT event_id, round(plain + l * q, 2) AS static_energy, round(plain + l * qs, 2) AS saturated_energy, round(plain + l * q + 0.5 * sqrt(u * u + v * v), 2) AS total_energy FROM b""")
def fn23_energies(spark, sf_dir):
    c = F.col
    q, qs = air.mixing_ratio(air.vapor_pressure(c("dewpoint")), c("pressure")), air.mixing_ratio(air.saturation_pressure(c("temperature")), c("pressure"))
    static = air.static_energy(c("temperature"), q, c("z"))
    rows = observations(spark, sf_dir).select("event_id", static.alias("static_energy"), air.static_energy(c("temperature"), qs, c("z")).alias("saturated_energy"), (static + 0.5 * F.abs("speed")).alias("total_energy"))
    return rounded(rows, "event_id", places=2)


@registered(f"""WITH {OBS}, w AS (SELECT event_id, temperature AS t, dewpoint AS d, pressure AS p,
        6.1078::DOUBLE * exp(5.0065::DOUBLE * ln(273.15::DOUBLE / dewpoint)) * exp(24.84573::DOUBLE * (1 - 273.15::DOUBLE / dewpoint)) AS e,
        6.1078::DOUBLE * exp(5.0065::DOUBLE * ln(273.15::DOUBLE / temperature)) * exp(24.84573::DOUBLE * (1 - 273.15::DOUBLE / temperature)) AS s FROM obs
    ), q AS (SELECT *, 622 * e / (p - e) AS w, 1 / (1 / (d - 56) + ln(t / d) / 800) + 56 AS l FROM w), r AS (SELECT *, p * w / (622 + w) AS ew FROM q)
    SELECT event_id, round(622 * s / (p - s), 4) AS w_sat, round(t * pow(1000 / p, 0.28537338::DOUBLE), 4) AS theta, round(l, 4) AS lcl_temp,
           round(273.15::DOUBLE * 5.0065::DOUBLE / (5.0065::DOUBLE - 19.83923::DOUBLE + sqrt(19.83923::DOUBLE ** 2 + 2 * 5.0065::DOUBLE * ln(6.1078::DOUBLE / ew))), 4) AS t_mr,
           round(t * pow(1000 / p, 0.28537338::DOUBLE * (1 - 0.00028::DOUBLE * w)) * exp((3.376::DOUBLE / l - 0.00254::DOUBLE) * w * (1 + 0.00081::DOUBLE * w)), 4) AS theta_e,
           round(t / (1 - e / p * (1 - 0.622::DOUBLE)), 4) AS t_v FROM r""")
def fn28_formula_library(spark, sf_dir):
    t, d, p = F.col("temperature"), F.col("dewpoint"), F.col("pressure")
    e = air.saturation_pressure_log(d)
    rows = observations(spark, sf_dir).select(
        "event_id", air.mixing_ratio(air.saturation_pressure_log(t), p).alias("w_sat"), air.potential_temperature(t, p).alias("theta"), air.condensation_temperature(t, d).alias("lcl_temp"),
        air.saturation_temperature(p, air.mixing_ratio(e, p)).alias("t_mr"), air.equivalent_temperature(t, d, p).alias("theta_e"), (t / (1 - e / p * (1 - air.EPSILON))).alias("t_v"),
    )
    return rounded(rows, "event_id")


_LEAST = "exp(5.0065::DOUBLE * ln(273.15::DOUBLE / {0})) * exp(24.84573::DOUBLE * (1 - 273.15::DOUBLE / {0}))"


@registered(f"""WITH RECURSIVE {OBS}, w AS (SELECT event_id, temperature * pow(1000 / pressure, 0.28537338::DOUBLE) AS theta, pressure, 6.1078::DOUBLE * {_LEAST.format("dewpoint")} AS e FROM obs WHERE dewpoint <= temperature
    ), q AS (SELECT event_id, theta, pressure, 622 * e / (pressure - e) AS w FROM w), b(n, event_id, theta, w, lo, hi) AS (
        SELECT 0, event_id, theta, w, 50.0::DOUBLE, pressure FROM q
        UNION ALL SELECT n + 1, event_id, theta, w, CASE WHEN up THEN lo ELSE m END, CASE WHEN up THEN m ELSE hi END FROM (
            SELECT *, (lo + hi) / 2 AS m, 273.15::DOUBLE * 5.0065::DOUBLE / (5.0065::DOUBLE - 19.83923::DOUBLE + sqrt(19.83923::DOUBLE ** 2 + 2 * 5.0065::DOUBLE * ln(6.1078::DOUBLE / ((lo + hi) / 2 * w / (622 + w)))))
                < theta * pow((lo + hi) / 2 / 1000, 0.28537338::DOUBLE) AS up FROM b WHERE n < 50))
    SELECT o.event_id, round((lo + hi) / 2, 4) AS lcl_pressure FROM obs o LEFT JOIN (SELECT * FROM b WHERE n = 50) f USING (event_id)""")
def fn28_condensation_pressure(spark, sf_dir):
    """Pressures at which lifted air condenses, by Newton's steps; SQL halves the interval fifty times."""
    found = air.condensation_pressure(F.col("temperature"), F.col("dewpoint"), F.col("pressure"))
    return rounded(observations(spark, sf_dir).select("event_id", found.alias("lcl_pressure")), "event_id")


_FULL = "exp(-6096.9385::DOUBLE / t + 16.635794::DOUBLE - 2.711193e-2 * t + 1.673952e-5 * t * t + 2.433502::DOUBLE * ln(t))"


@registered(_REF + f""", o AS (SELECT event_id, z, rp, rh, temperature AS t, (pressure * 100) / (287 * temperature) AS rho, CAST(event_id % 25 AS DOUBLE) + 0.5 AS q FROM refd
    ), a AS (SELECT *, t * rho * q / 1000 * 461 / 100 AS v, t * rho * 287 / 100 AS d, {_FULL} AS s FROM o)
    SELECT event_id, round(d + v - rp / 100, 3) + 0 AS higher, round(1005.7::DOUBLE * t + 2501 * q + 9.81::DOUBLE * z, 2) AS energy, round(1005.7::DOUBLE * t + 2501 * q + 9.81::DOUBLE * z - rh, 2) + 0 AS energy_above,
           round(2840 / (3.5::DOUBLE * ln(t) - ln(v) - 4.805::DOUBLE) + 55, 4) AS lifted, round(622 * s / d, 4) AS saturated, round(CASE WHEN 100 * v / s > 100 THEN 622 * s / d ELSE q END, 4) AS ratio FROM a""")
def fn27_departures(spark, sf_dir):
    """The rest of the analysis' thermodynamics: against the reference, lifted, and with moisture cut at saturation."""
    c, ref = F.col, profile.reference(F.col("z"))
    rows = _referenced(spark, sf_dir)
    found = air.departures(c("temperature"), (c("event_id") % 25) + 0.5, air.dry_density(c("pressure"), c("temperature")), c("z"), ref["pressure"], ref["energy"])
    places = {"higher": 3, "energy": 2, "energy_above": 2}
    return rows.select("event_id", *[(F.round(v, places.get(n, 4)) + 0.0).alias(n) for n, v in found.items()])


@registered(f"""WITH {SAMPLES}, f AS (SELECT point, 280 + z / 5 AS t, 1 + x / 100 AS rho, y AS q, sin(point) AS ts, cos(point) / 100 AS ds, sin(point * 2) / 10 AS qs FROM samples)
    SELECT point, round((ts * rho + ds * t) * 287 / 100 + (ts * rho * q / 1000 + (ds * q + qs * rho) * t / 1000) * 461 / 100, 4) + 0 AS slope FROM f""")
def dg03_pressure_gradient(spark, sf_dir):
    c, i = F.col, F.col("point")
    slope = air.pressure_slope(280 + c("z") / 5, 1 + c("x") / 100, c("y"), F.sin(i), F.cos(i) / 100, F.sin(i * 2) / 10)
    return rounded(samples(spark, sf_dir).select("point", slope.alias("slope")), "point")


@registered(f"""WITH {COLUMNS}, two AS (SELECT ray, gate, k, CASE WHEN dbz IS NULL THEN -32768 ELSE CAST(round(dbz) AS INTEGER) - 20 END AS v FROM columns, (SELECT unnest([0, 1]) AS k))
    SELECT ray, CAST(row_number() OVER (PARTITION BY ray ORDER BY gate, k) AS INTEGER) AS place, v AS value FROM two""")
def fn32_run_lengths(spark, sf_dir):
    """Rays as runs of literal and missing words, two of each gate, decoded again."""
    v = F.pmod(F.round("dbz").cast("int") - 20, F.lit(65536))
    run = F.when(F.col("dbz").isNull(), F.array(F.lit(2))).otherwise(F.array(F.lit(0x8002), v, v))
    held = columns(spark, sf_dir).groupBy("ray").agg(F.sort_array(F.collect_list(F.struct("gate", run.alias("run")))).alias("g"))
    rays = held.select("ray", F.concat(F.flatten("g.run"), F.array(F.lit(1))).alias("words"))
    found = runs.decoded(rays, "ray", "words", -32768).select("ray", F.posexplode("values").alias("place", "value"))
    return found.select("ray", (F.col("place") + 1).alias("place"), "value")


@registered(f"WITH {COLUMNS}, r AS (SELECT ray, gate, CASE WHEN dbz IS NULL THEN -32768 ELSE CAST(round(dbz * 100) AS INTEGER) END AS raw FROM columns) SELECT ray, gate, round(CASE WHEN raw <> -32768 THEN raw / 100.0::DOUBLE END, 4) AS value FROM r")
def fn33_scaled_words(spark, sf_dir):
    raw = F.coalesce(F.round(F.col("dbz") * 100).cast("int"), F.lit(-32768))
    return rounded(columns(spark, sf_dir).select("ray", "gate", radar.scaled(raw, F.lit(100.0), -32768).alias("value")), "ray", "gate")


@registered(f"""WITH {OBS}, a AS (SELECT event_id, radians(coalesce(speed, 0) % 20 - 10) AS r, radians(y / 4) AS p, radians(wdir) AS h, radians(x / 3) AS d, radians(event_id * 7 % 360) AS t, radians(event_id % 41 - 20) AS a FROM obs
    ), v AS (SELECT *, cos(t + r) * sin(d) * cos(a) * sin(p) + cos(d) * sin(t + r) * cos(a) - sin(d) * cos(p) * sin(a) AS vx,
               -cos(t + r) * cos(d) * cos(a) * sin(p) + sin(d) * sin(t + r) * cos(a) + cos(p) * cos(d) * sin(a) AS vy, cos(p) * cos(a) * cos(t + r) + sin(p) * sin(a) AS vz FROM a)
    SELECT event_id, round(sin(atan2(vx, vy) + h + d), 6) + 0 AS east, round(cos(atan2(vx, vy) + h + d), 6) + 0 AS north, round(degrees(asin(vz)), 4) + 0 AS elevation FROM v""")
def fn34_airborne_beams(spark, sf_dir):
    """Earth-relative directions of an airborne radar's beams, azimuth as its two components."""
    c, i = F.col, F.col("event_id")
    azimuth, elevation = radar.earth_angles(F.coalesce("speed", F.lit(0.0)) % 20 - 10, c("y") / 4, c("wdir"), c("x") / 3, (i * 7 % 360).cast("double"), (i % 41 - 20).cast("double"))
    rows = observations(spark, sf_dir).select("event_id", F.radians(azimuth).alias("az"), elevation.alias("elevation"))
    rows = rows.select("event_id", (F.round(F.sin("az"), 6) + 0.0).alias("east"), (F.round(F.cos("az"), 6) + 0.0).alias("north"), "elevation")
    return rounded(rows, "event_id", "east", "north")


@registered(f"WITH {SAMPLES} SELECT point AS second, round(value, 2) AS value, 0.5::DOUBLE AS inverse_error, x, y, CASE WHEN point % 9 = 0 THEN -999 ELSE z END AS z, CAST(point % 12 AS INTEGER) AS type, CAST(point % 5 AS DOUBLE) AS weight_0_0, -1.0::DOUBLE AS weight_6_3 FROM samples")
def snk06_equations(spark, sf_dir):
    """Equations as text, and back."""
    i = F.col("point")
    rows = samples(spark, sf_dir).select(F.round("value", 2).alias("value"), F.lit(0.5).alias("inverse_error"), "x", "y", F.when(i % 9 != 0, F.col("z")).alias("z"), (i % 12).cast("int").alias("type"), i.alias("second"), *[((i % 5).cast("double") if n == "weight_0_0" else F.lit(-1.0)).alias(n) for n in text.WEIGHTS])
    path = new_folder(spark, "equations")
    text.write_equations(rows, path)
    return text.read_text(spark, path, "equations").select("second", "value", "inverse_error", "x", "y", "z", "type", "weight_0_0", "weight_6_3")


@registered(f"WITH {SAMPLES} SELECT point, x, y, round(value, 2) AS value, CASE WHEN point % 4 > 0 THEN z END AS z FROM samples")
def snk03_fields(spark, sf_dir):
    """Gridded fields as tab-separated text with a header, and back; missing is -999."""
    rows = samples(spark, sf_dir).select("point", "x", "y", F.round("value", 2).alias("value"), F.when(F.col("point") % 4 > 0, F.col("z")).alias("z"))
    path = new_folder(spark, "fields")
    text.write_fields(rows, path)
    return spark.read.option("sep", "\t").option("header", True).option("nullValue", "-999").schema(rows.schema).csv(path)


@registered(f"""WITH {SAMPLES} SELECT CAST(point % 7 AS INTEGER) AS variable, CAST(point AS INTEGER) AS i, CAST(z AS INTEGER) AS j, CAST(point % 40 AS INTEGER) AS k, round(value, 2) AS background FROM samples""")
def snk05_coefficients(spark, sf_dir):
    """Coefficients written after an analysis, read as the next one's background."""
    i = F.col("point")
    rows = samples(spark, sf_dir).select((i % 7).cast("int").alias("Variable"), i.cast("int").alias("I"), F.col("z").cast("int").alias("J"), (i % 40).cast("int").alias("K"), F.round("value", 2).alias("Background"), (F.round("value", 2) + 1).alias("Analysis"), F.lit(1.0).alias("Increment"))
    path = new_folder(spark, "coefficients")
    text.write_fields(rows, path)
    return text.read_text(spark, path, "coefficients").withColumn("background", F.round("background", 2))


@registered(f"""WITH {COLUMNS}, g AS (SELECT ray, gate, sw, pow(10, (dbz - 20) / 10) AS snr, exp(-8.0::DOUBLE * pow(pi() * sw * 0.0005::DOUBLE / 0.03::DOUBLE, 2)) AS rho FROM columns)
    SELECT ray, gate, round(10 * log10(1 + sqrt(1 / (2 * 16.0::DOUBLE) * (1 + rho * rho + pow(1 / snr, 2) + 2 / snr))), 4) AS reflectivity_spread,
           round(sqrt(0.03::DOUBLE * 0.03::DOUBLE / (32 * pow(pi() * 0.0005::DOUBLE * rho, 2)) / 16 * (1 - rho * rho + pow(1 / snr, 2) + 2 / snr)), 4) AS velocity_spread FROM g""")
def utl05_measured_spread(spark, sf_dir):
    """How far a radar's reflectivity and velocity scatter, by width and noise; NULL where either is missing."""
    z, v = radar.measured_spread(F.col("sw"), F.col("dbz") - 20, 0.0005, 0.03, 16)
    return rounded(columns(spark, sf_dir).select("ray", "gate", z.alias("reflectivity_spread"), v.alias("velocity_spread")), "ray", "gate")


@registered(f"WITH {OBS}, w AS (SELECT event_id, x, y, {WIND}, sqrt(x * x + y * y) AS r FROM obs) SELECT event_id, CASE WHEN r > 0 THEN round((u * x + v * y) / r, 4) + 0 END AS radial, CASE WHEN r > 0 THEN round((v * x - u * y) / r, 4) + 0 END AS tangential FROM w")
def fn13_polar_winds(spark, sf_dir):
    """Winds outward from a center and around it."""
    c = F.col
    u, v = wind.eastward(c("speed"), c("wdir")), wind.northward(c("speed"), c("wdir"))
    radial, tangential = wind.around(u, v, c("x"), c("y"))
    return rounded(observations(spark, sf_dir).select("event_id", radial.alias("radial"), tangential.alias("tangential")), "event_id")
