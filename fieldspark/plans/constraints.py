"""Queries on filters, masks, further observation operators and iterative scalars."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import projection, radar, wind
from ..operators import grid
from .equations import _FALL, _blend
from .grids import _MESH, bounded
from .tables import GATES, OBS, SAMPLES, gates, observations, registered, rounded, samples


@registered(f"""WITH {OBS}, p AS (SELECT event_id, CASE WHEN event_id % 19 <> 0 THEN x END AS lon, CASE WHEN event_id % 23 <> 0 THEN y END AS lat FROM obs)
    SELECT event_id, round(lon, 4) + 0 AS lon, round(lat, 4) + 0 AS lat FROM p WHERE lon IS NOT NULL AND lat IS NOT NULL""")
def flt03_coordinates(spark, sf_dir):
    i = F.col("event_id")
    rows = observations(spark, sf_dir).select("event_id", F.when(i % 19 != 0, F.col("x")).alias("lon"), F.when(i % 23 != 0, F.col("y")).alias("lat"))
    return rounded(rows.where(F.col("lon").isNotNull() & F.col("lat").isNotNull()), "event_id")


@registered(f"""WITH {OBS} SELECT event_id, round(x, 4) + 0 AS x, round(y, 4) + 0 AS y, round(z, 4) + 0 AS z FROM obs
    WHERE x BETWEEN -15 - 4.5 AND 15 + 4.5 AND y BETWEEN -15 - 4.5 AND 15 + 4.5 AND z >= 0""")
def flt06_background_domain(spark, sf_dir):
    """The box grown by a step and three radii of influence; open at the top."""
    grown, c = 1.5 + 3 * 1.0, F.col
    rows = observations(spark, sf_dir).where(c("x").between(-15 - grown, 15 + grown) & c("y").between(-15 - grown, 15 + grown) & (c("z") >= 0))
    return rounded(rows.select("event_id", "x", "y", "z"), "event_id")


@registered(f"""WITH {OBS}, u AS (SELECT 'speed' AS variable, speed AS value FROM obs UNION ALL SELECT 'temperature', temperature FROM obs UNION ALL SELECT 'dewpoint', dewpoint FROM obs)
    SELECT variable, count(value) AS present, count(*) - count(value) AS missing FROM u GROUP BY variable""")
def flt07_presence(spark, sf_dir):
    rows = observations(spark, sf_dir).select("speed", "temperature", "dewpoint").unpivot([], ["speed", "temperature", "dewpoint"], "variable", "value")
    return rows.groupBy("variable").agg(F.count("value").alias("present"), (F.count("*") - F.count("value")).alias("missing"))


@registered(f"""WITH {GATES}, g AS (SELECT ray, gate, site, dbz, CASE WHEN sw > 0 THEN vr END AS vr FROM gates)
    SELECT ray, gate, site, round(dbz, 4) AS dbz, round(vr, 4) + 0 AS vr FROM g WHERE vr IS NOT NULL OR dbz IS NOT NULL""")
def flt08_gate_present(spark, sf_dir):
    rows = gates(spark, sf_dir).select("ray", "gate", "site", "dbz", F.when(F.col("sw") > 0, F.col("vr")).alias("vr"))
    return rounded(rows.where(F.col("vr").isNotNull() | F.col("dbz").isNotNull()), "ray", "gate", "site")


@registered(f"WITH {GATES} SELECT ray, gate, site, elevation FROM gates WHERE elevation <= 40")
def flt09_max_elevation(spark, sf_dir):
    return gates(spark, sf_dir).where("elevation <= 40").select("ray", "gate", "site", "elevation")


@registered(f"""WITH {GATES} SELECT ray, gate, site, round(CASE WHEN dbz >= 10 THEN dbz END, 4) AS dbz, round(CASE WHEN dbz >= 10 THEN vr END, 4) + 0 AS vr,
        round(CASE WHEN dbz >= 10 THEN sw END, 4) AS sw FROM gates""")
def flt10_output_mask(spark, sf_dir):
    """Every field is missing where the reflectivity lies below the threshold or is missing itself."""
    rows = gates(spark, sf_dir)
    return rounded(rows.select("ray", "gate", "site", *[F.when(F.col("dbz") >= 10, F.col(c)).alias(c) for c in ("dbz", "vr", "sw")]), "ray", "gate", "site")


@registered(f"WITH {SAMPLES} SELECT point, round(sqrt(x * x + y * y), 4) AS r, round(CASE WHEN x * x + y * y > 0 THEN value / sqrt(x * x + y * y) END, 4) AS per_radius FROM samples")
def flt11_axis_mask(spark, sf_dir):
    r = F.hypot("x", "y")
    return rounded(samples(spark, sf_dir).select("point", r.alias("r"), F.when(r > 0, F.col("value") / r).alias("per_radius")), "point")


@registered(f"WITH {OBS} SELECT event_id, round(CASE WHEN event_id % 7 = 0 THEN 0 ELSE speed END, 4) + 0 AS wind, round(coalesce(CASE WHEN event_id % 7 = 0 THEN NULL ELSE speed END, -35), 4) + 0 AS dbz FROM obs")
def flt12_nan_default(spark, sf_dir):
    held = F.when(F.col("event_id") % 7 == 0, F.lit(float("nan"))).otherwise(F.col("speed"))
    return rounded(observations(spark, sf_dir).select("event_id", F.nanvl(held, F.lit(0.0)).alias("wind"), F.coalesce(F.nanvl(held, F.lit(None).cast("double")), F.lit(-35.0)).alias("dbz")), "event_id")


@registered(f"WITH {GATES} SELECT count(*) AS equations, count(CASE WHEN sw = 0 THEN 1 END) AS without_weight FROM gates")
def flt15_zero_weights(spark, sf_dir):
    return gates(spark, sf_dir).agg(F.count("*").alias("equations"), F.count(F.when(F.col("sw") == 0, 1)).alias("without_weight"))


@registered(f"""WITH {OBS}, s AS (SELECT event_id, speed, (wdir + 180) % 360 AS d FROM obs WHERE z <= 7500 AND speed IS NOT NULL)
    SELECT event_id, CAST(0 AS INTEGER) AS variable, round(-speed * sin(radians(d)), 4) + 0 AS value, round(0.4::DOUBLE, 4) AS inverse_error FROM s
    UNION ALL SELECT event_id, 1, round(-speed * cos(radians(d)), 4) + 0, round(0.4::DOUBLE, 4) FROM s""")
def prj06_scatterometer(spark, sf_dir):
    """Winds given by where they blow to; rows of a rain probability over one half go: here it grows with height, to 1 at 15 km."""
    rows = observations(spark, sf_dir).where("z / 15000 <= 0.5 AND speed IS NOT NULL")
    towards = (F.col("wdir") + 180) % 360
    u, v = wind.eastward(F.col("speed"), towards), wind.northward(F.col("speed"), towards)
    each = F.array(*[F.struct(F.lit(k).alias("variable"), c.alias("value"), F.lit(1 / 2.5).alias("inverse_error")) for k, c in enumerate((u, v))])
    return rounded(rows.select("event_id", F.inline(each)), "event_id", "variable")


_SLOPES = SAMPLES + ", slope AS (SELECT point, CAST(point * 31 % 101 AS DOUBLE) / 100 - 0.5::DOUBLE AS hx, CAST(point * 17 % 97 AS DOUBLE) / 100 - 0.5::DOUBLE AS hy FROM samples), s AS (SELECT *, sqrt(1 + hx * hx + hy * hy) AS s FROM slope)"


@registered(f"""WITH {_SLOPES} SELECT point, k AS variable, round(-hx / s, 4) + 0 AS wx, round(-hy / s, 4) + 0 AS wy, round(1 / s, 4) AS wz FROM s, (SELECT CAST(unnest([0, 1]) AS INTEGER) AS k)
    UNION ALL SELECT point, CAST(2 AS INTEGER), round(hx, 4) + 0, round(hy, 4) + 0, -1.0::DOUBLE FROM s""")
def prj09_terrain(spark, sf_dir):
    """Of each terrain point: no change of u and of v across the ground, and no flow through it."""
    p = F.col("point")
    rows = samples(spark, sf_dir).select("point", ((p * 31 % 101).cast("double") / 100 - 0.5).alias("hx"), ((p * 17 % 97).cast("double") / 100 - 0.5).alias("hy"))
    hx, hy = F.col("hx"), F.col("hy")
    s = F.sqrt(1 + hx * hx + hy * hy)
    weights = [(0, -hx / s, -hy / s, 1 / s), (1, -hx / s, -hy / s, 1 / s), (2, hx, hy, F.lit(-1.0))]
    each = F.array(*[F.struct(F.lit(k).alias("variable"), a.alias("wx"), b.alias("wy"), c.alias("wz")) for k, a, b, c in weights])
    return rounded(rows.select("point", F.inline(each)), "point", "variable")


@registered(f"""WITH {GATES} SELECT ray, gate, site, round(vr, 4) + 0 AS value, round(greatest(sw * 0.5::DOUBLE + ln(distance / 1000), 1), 4) AS error FROM gates""")
def prj10_lidar(spark, sf_dir):
    error = F.greatest(F.col("sw") * 0.5 + F.log(F.col("distance") / 1000), F.lit(1.0))
    return rounded(gates(spark, sf_dir).select("ray", "gate", "site", F.col("vr").alias("value"), error.alias("error")), "ray", "gate", "site")


@registered(f"""WITH {GATES}, {_FALL}, w AS (SELECT *, pow(zz / 670, 0.5587::DOUBLE) AS ice, pow(zz / 14630, 0.6905::DOUBLE) AS rain FROM z), q AS (SELECT ray, gate, {_blend("rain", "ice")} AS q FROM w)
    SELECT ray, gate, CAST(6 AS INTEGER) AS variable, round(0.5::DOUBLE * ((q + 1e-7) - 1e-14 / (q + 1e-7)), 4) + 0 AS value FROM q""")
def prj12_water_equations(spark, sf_dir):
    from ..functions import air

    content = radar.water_content(F.col("dbz"), F.col("gate") * 1000.0, freezing=3500.0)
    return rounded(gates(spark, sf_dir).where("dbz IS NOT NULL").select("ray", "gate", F.lit(6).alias("variable"), air.widen(content).alias("value")), "ray", "gate", "variable")


@registered(f"WITH {_MESH} SELECT ix, iy, iz, 0.0::DOUBLE AS value, 0.5::DOUBLE AS inverse_error, 1.0::DOUBLE AS du_dx, 1.0::DOUBLE AS dv_dy, 1.0::DOUBLE AS dw_dz FROM mx, my, mz")
def prj17_mass_continuity(spark, sf_dir):
    """A row of every node of a mesh over the samples' domain: the divergence of momentum is zero."""
    nodes = grid.mesh(spark, bounded(samples(spark, sf_dir), {"x": 2.0, "y": 2.0, "z": 10.0}))
    return nodes.select("ix", "iy", "iz", F.lit(0.0).alias("value"), F.lit(0.5).alias("inverse_error"), *[F.lit(1.0).alias(f"d{u}_d{a}") for u, a in zip("uvw", "xyz", strict=True)])


@registered(f"""WITH {GATES}, t AS (SELECT ray, max(distance) AS top FROM gates WHERE dbz IS NOT NULL GROUP BY ray)
    SELECT ray, 'bottom' AS place, 0.0::DOUBLE AS z, 0.0::DOUBLE AS value FROM t UNION ALL SELECT ray, 'top', top, 0.0::DOUBLE FROM t""")
def prj18_no_flow_at_ends(spark, sf_dir):
    tops = gates(spark, sf_dir).where("dbz IS NOT NULL").groupBy("ray").agg(F.max("distance").alias("top"))
    each = F.array(F.struct(F.lit("bottom").alias("place"), F.lit(0.0).alias("z")), F.struct(F.lit("top").alias("place"), F.col("top").alias("z")))
    return tops.select("ray", F.inline(each)).withColumn("value", F.lit(0.0))


@registered(f"WITH {GATES} SELECT ray, gate, site, round(nullif(l, -1), 4) AS sw FROM (SELECT ray, gate, site, CASE WHEN sw < 0.2 THEN -1 ELSE sw END AS l FROM gates)")
def fn04_sentinel(spark, sf_dir):
    coded = F.when(F.col("sw") < 0.2, F.lit(-1.0)).otherwise(F.col("sw"))
    return rounded(gates(spark, sf_dir).select("ray", "gate", "site", F.nullif(coded, F.lit(-1.0)).alias("sw")), "ray", "gate", "site")


@registered(f"""WITH {OBS} SELECT event_id, strftime(make_timestamp(second * 1000000), '%Y%m%d') AS date_text, CAST(second - second % 86400 AS BIGINT) AS day_start, CAST(second % 86400 AS BIGINT) AS of_day FROM obs""")
def fn05_parsed_times(spark, sf_dir):
    """Dates and times as text, parsed again; what does not parse is an error."""
    at = F.timestamp_seconds("second")
    rows = observations(spark, sf_dir).select("event_id", F.date_format(at, "yyyyMMdd").alias("date_text"), F.date_format(at, "HHmmss").alias("time_text"))
    clock = F.unix_timestamp(F.to_timestamp(F.concat(F.lit("19700101"), "time_text"), "yyyyMMddHHmmss"))
    return rows.select("event_id", "date_text", F.unix_timestamp(F.to_timestamp("date_text", "yyyyMMdd")).alias("day_start"), clock.alias("of_day"))


@registered(f"WITH {OBS} SELECT event_id, CAST(1704067200 + (event_id % 40) * 3600 + second % 3600 AS BIGINT) AS second FROM obs")
def fn09_hour_rollover(spark, sf_dir):
    """Hours past 23 run on into the next day."""
    hours, rest = (F.col("event_id") % 40).cast("int"), (F.col("second") % 3600).cast("int")
    at = F.to_timestamp(F.lit("2024-01-01")) + F.make_dt_interval(F.lit(0), hours, F.lit(0), rest)
    return observations(spark, sf_dir).select("event_id", F.unix_seconds(at).alias("second"))


@registered(f"WITH {OBS} SELECT event_id, round(y + 20, 6) + 0 AS latitude, round(x / 4, 6) + 0 AS longitude FROM obs")
def fn10_projection_round_trip(spark, sf_dir):
    x, y = projection.forward(F.col("y") + 20, F.col("x") / 4)
    rows = observations(spark, sf_dir).select("event_id", x.alias("px"), y.alias("py"))
    latitude, longitude = projection.reverse(F.col("px"), F.col("py"))
    return rounded(rows.select("event_id", latitude.alias("latitude"), longitude.alias("longitude")), "event_id", places=6)


@registered(f"WITH {OBS} SELECT event_id, round(-8000 * ln(pressure / 1013.25::DOUBLE), 3) + 0 AS height FROM obs")
def fn16_height_of_pressure(spark, sf_dir):
    """Newton steps on the profile p(z) = 1013.25 exp(-z / 8000), from the ground."""

    def step(z, _):
        p = 1013.25 * F.exp(-z / 8000)
        return z + (p - F.col("pressure")) / (p / 8000)

    height = F.aggregate(F.sequence(F.lit(1), F.lit(12)), F.lit(0.0), step)
    return rounded(observations(spark, sf_dir).select("event_id", height.alias("height")), "event_id", places=3)
