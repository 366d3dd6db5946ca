"""Queries on further aggregates, ordered columns, sorts and simulated radars."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import radar
from .tables import COLUMNS, GATES, OBS, SAMPLES, columns, gates, observations, registered, rounded, samples


@registered(f"""WITH {SAMPLES} SELECT CAST(floor(x) AS BIGINT) AS ix, CAST(floor(y) AS BIGINT) AS iy, count(*) AS n_points, round(avg(value), 4) AS mean, round(avg(z), 4) AS height
    FROM samples GROUP BY 1, 2""")
def agg04_background_mean(spark, sf_dir):
    cells = samples(spark, sf_dir).groupBy(F.floor("x").alias("ix"), F.floor("y").alias("iy"))
    return rounded(cells.agg(F.count("*").alias("n_points"), F.avg("value").alias("mean"), F.avg("z").alias("height")), "ix", "iy", "n_points")


@registered(f"""WITH {SAMPLES}, cells AS (SELECT CAST(floor(x * 2) AS BIGINT) AS ix, CAST(floor(y * 2) AS BIGINT) AS iy, avg(value) AS mean FROM samples GROUP BY 1, 2
    ), around AS (SELECT ix + dx AS ix, iy + dy AS iy, mean FROM cells, (VALUES (1, 0), (-1, 0), (0, 1), (0, -1)) d(dx, dy)
    ), held AS (SELECT * FROM around WHERE ix BETWEEN 0 AND 39 AND iy BETWEEN 0 AND 39)
    SELECT ix, iy, count(*) AS n_near, round(avg(mean), 4) AS filled FROM held ANTI JOIN cells USING (ix, iy) GROUP BY ix, iy""")
def agg06_hole_fill(spark, sf_dir):
    """Cells without a sample take the mean of the neighbours that have one; each cell tells its neighbours."""
    cells = samples(spark, sf_dir).groupBy(F.floor(F.col("x") * 2).alias("ix"), F.floor(F.col("y") * 2).alias("iy")).agg(F.avg("value").alias("mean"))
    steps = F.array(*[F.struct((F.col("ix") + dx).alias("ix"), (F.col("iy") + dy).alias("iy")) for dx, dy in ((1, 0), (-1, 0), (0, 1), (0, -1))])
    told = cells.select(F.explode(steps).alias("to"), "mean").select("to.ix", "to.iy", "mean").where(F.col("ix").between(0, 39) & F.col("iy").between(0, 39))
    holes = told.groupBy("ix", "iy").agg(F.count("*").alias("n_near"), F.avg("mean").alias("filled"))
    return rounded(holes.join(cells.select("ix", "iy"), ["ix", "iy"], "left_anti"), "ix", "iy", "n_near")


@registered(f"WITH {OBS} SELECT event_type, count(speed) AS n, round(sqrt(avg(speed * speed)), 4) AS rms FROM obs GROUP BY event_type")
def agg08_rms_by_variable(spark, sf_dir):
    square = F.col("speed") * F.col("speed")
    return rounded(observations(spark, sf_dir).groupBy("event_type").agg(F.count("speed").alias("n"), F.sqrt(F.avg(square)).alias("rms")), "event_type", "n")


@registered(f"WITH {GATES} SELECT ray, round(max(CASE WHEN dbz IS NOT NULL THEN distance END), 4) AS top, round(max(sw), 4) AS most FROM gates GROUP BY ray")
def agg14_column_top(spark, sf_dir):
    return rounded(gates(spark, sf_dir).groupBy("ray").agg(F.max(F.when(F.col("dbz").isNotNull(), F.col("distance"))).alias("top"), F.max("sw").alias("most")), "ray")


@registered(f"""WITH {COLUMNS}, n AS (SELECT ray, gate, (vr + lead(vr) OVER (PARTITION BY ray ORDER BY gate)) / 2 AS centre FROM columns)
    SELECT ray, gate, round(centre, 4) + 0 AS centre FROM n WHERE centre IS NOT NULL""")
def win04_destagger(spark, sf_dir):
    along = Window.partitionBy("ray").orderBy("gate")
    rows = columns(spark, sf_dir).select("ray", "gate", ((F.col("vr") + F.lead("vr").over(along)) / 2).alias("centre"))
    return rounded(rows.where("centre IS NOT NULL"), "ray", "gate")


@registered(f"WITH {COLUMNS} SELECT ray, gate, CAST(row_number() OVER (PARTITION BY ray ORDER BY gate) * 150 AS DOUBLE) AS along FROM columns")
def win06_running_range(spark, sf_dir):
    turn = F.row_number().over(Window.partitionBy("ray").orderBy("gate"))
    return columns(spark, sf_dir).select("ray", "gate", (turn * 150).cast("double").alias("along"))


@registered(f"""WITH {OBS}, r AS (SELECT event_type, second, event_id, row_number() OVER (PARTITION BY event_type ORDER BY second, event_id) AS k FROM obs)
    SELECT event_type, second, event_id FROM r WHERE k = 1""")
def srt02_first_match(spark, sf_dir):
    first = observations(spark, sf_dir).groupBy("event_type").agg(F.min(F.struct("second", "event_id")).alias("f"))
    return first.select("event_type", "f.second", "f.event_id")


@registered(f"WITH {OBS} SELECT second, event_type, min(event_id) AS event_id, count(*) AS n FROM obs GROUP BY second, event_type")
def srt04_same_time_and_station(spark, sf_dir):
    return observations(spark, sf_dir).groupBy("second", "event_type").agg(F.min("event_id").alias("event_id"), F.count("*").alias("n"))


@registered(f"""WITH {GATES} SELECT ray, gate, site,
        round((vr - 120) * sin(radians(azimuth)) * cos(radians(elevation)) + (sw + 30) * cos(radians(azimuth)) * cos(radians(elevation)) - 3 * sin(radians(elevation)), 4) + 0 AS seen,
        round(vr * sin(radians(azimuth)) * cos(radians(elevation)) + sw * cos(radians(azimuth)) * cos(radians(elevation)) - sin(radians(elevation)), 4) + 0 AS ground FROM gates""")
def utl01_platform_velocity(spark, sf_dir):
    """A wind (vr, sw, -1) as a radar that moves with (120, -30, 2) sees it, and as one at rest would."""
    wu, wv, ww = radar.doppler_weights(F.col("azimuth"), F.col("elevation"))
    u, v, w = F.col("vr"), F.col("sw"), F.lit(-1.0)
    return rounded(gates(spark, sf_dir).select("ray", "gate", "site", ((u - 120) * wu + (v + 30) * wv + (w - 2) * ww).alias("seen"), (u * wu + v * wv + w * ww).alias("ground")), "ray", "gate", "site")


@registered(f"WITH {GATES} SELECT ray, gate, site, round(dbz - (-40 + 20 * log10(distance / 1000)), 4) AS snr FROM gates WHERE dbz IS NOT NULL")
def utl04_signal_to_noise(spark, sf_dir):
    snr = F.col("dbz") - (-40 + 20 * F.log10(F.col("distance") / 1000))
    return rounded(gates(spark, sf_dir).where("dbz IS NOT NULL").select("ray", "gate", "site", snr.alias("snr")), "ray", "gate", "site")
