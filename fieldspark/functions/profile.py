"""The reference profile of the moist tropics, and what rows at a height take from it.

Potential temperature and transformed moisture are linear in the logarithm of
height between levels; Exner's function follows from hydrostatic balance in
steps of a metre.  The table has a row for each metre, whatever the data, so
that an interpolation join is an equi-join on the metre.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import air

# fixed values: height in m, potential temperature in K, mixing ratio in g/kg; surface pressure in hPa; constants of air
LEVELS = [
    (10, 298.6949, 18.63960), (124, 299.6500, 18.58188), (810, 301.688, 15.30626), (1541, 304.5541, 11.98349), (3178, 312.2750, 6.76311),
    (4437, 317.8749, 4.15019), (5887, 324.8602, 2.42535), (7596, 332.5846, 1.11535), (9690, 339.6121, 0.32924), (10949, 342.8986, 0.13712),
    (12418, 346.4510, 0.04282), (14203, 353.9290, 0.03), (16590, 383.2672, 0.03), (20726, 494.1519, 0.010), (40000, 1010.8810, 0.001),
]
SURFACE, GAS, HEAT, GRAVITY, LATENT = 1014.80, 287.04, 1005.7, 9.81, 2.5e6


def _linear(log_z: Column, low: Column, high: Column, a: Column, b: Column) -> Column:
    return a + (b - a) * (log_z - F.log(low)) / (F.log(high) - F.log(low))


def metres(sounding: DataFrame) -> DataFrame:
    """metre, theta, b, exner and those of the next metre, of a sounding (z, theta, q): one row for each metre it spans."""
    ordered = Window.orderBy("z")  # the levels of one sounding, and the metres they span: not the data's size
    level = sounding.select(F.col("z").cast("double").alias("z"), "theta", air.widen(F.col("q")).alias("b"), "q")
    ahead = [F.lead(c).over(ordered).alias(f"{c}_1") for c in ("z", "theta", "b")]
    level = level.select("*", *ahead).where("z_1 IS NOT NULL")
    each = level.withColumn("metre", F.explode(F.sequence(F.col("z").cast("long"), F.col("z_1").cast("long") - 1)))
    log_m = F.log(F.col("metre"))
    each = each.select("metre", _linear(log_m, F.col("z"), F.col("z_1"), F.col("theta"), F.col("theta_1")).alias("theta"), _linear(log_m, F.col("z"), F.col("z_1"), F.col("b"), F.col("b_1")).alias("b"))
    up = Window.orderBy("metre")
    below = F.lag("theta").over(up)
    each = each.withColumn("fallen", F.coalesce(-GRAVITY / (HEAT * 0.5 * (F.col("theta") + below)), F.lit(0.0)))
    ratio = air.narrow(F.first("b").over(up)) / 1000
    base = F.pow((SURFACE - SURFACE * (ratio / (ratio + air.EPSILON))) / 1000, GAS / HEAT)
    each = each.withColumn("exner", base + F.sum("fallen").over(up.rowsBetween(Window.unboundedPreceding, 0))).drop("fallen")
    return each.select("*", *[F.lead(c).over(up).alias(f"{c}_1") for c in ("theta", "b", "exner")]).where("theta_1 IS NOT NULL")


def sounding(spark) -> DataFrame:
    return spark.createDataFrame([(float(z), t, q) for z, t, q in LEVELS], "z double, theta double, q double")


def with_reference(rows: DataFrame, table: DataFrame, z: str = "z") -> DataFrame:
    """rows with ref_theta, ref_b, ref_exner at their height (10 m where lower), and their slopes; rows above the table go."""
    at = F.greatest(F.col(z).cast("double"), F.lit(10.0))
    keyed = rows.withColumn("metre", F.floor(at))
    met = keyed.join(F.broadcast(table), "metre")  # a row for each metre of one sounding
    out = {}
    for c in ("theta", "b", "exner"):
        span = F.log(F.col("metre") + 1) - F.log(F.col("metre"))
        out[f"ref_{c}"] = F.col(c) + (F.col(f"{c}_1") - F.col(c)) * (F.log(at) - F.log(F.col("metre"))) / span
        out[f"slope_{c}"] = (F.col(f"{c}_1") - F.col(c)) / span / at
    return met.withColumns(out).drop("metre", *table.columns)


def reference(z: Column) -> dict[str, Column]:
    """Values and slopes per metre of the reference air, from the columns of with_reference."""
    theta, b, exner = (F.col(f"ref_{c}") for c in ("theta", "b", "exner"))
    q = air.narrow(b) / 1000
    temperature = exner * theta
    dry_pressure = 100_000 * F.pow(exner, HEAT / GAS)
    dry = dry_pressure / (temperature * GAS)
    moist, pressure = dry * (1 + q), dry_pressure * (1 + q / air.EPSILON)
    q_slope = 0.002 * F.col("slope_b")
    t_slope = exner * F.col("slope_theta") + theta * F.col("slope_exner")
    p_slope = -moist * GRAVITY
    dry_slope = (p_slope - air.EPSILON * dry_pressure * q_slope) / (1 + air.EPSILON * q)
    return {
        "b": b, "temperature": temperature, "dry": dry, "moist": moist, "pressure": pressure, "energy": HEAT * temperature + GRAVITY * z + LATENT * q,
        "b_slope": F.col("slope_b"), "temperature_slope": t_slope, "pressure_slope": dry_slope,
        "dry_slope": (dry_slope / temperature - dry_pressure * t_slope / (temperature * temperature)) / GAS,
        "moist_slope": (p_slope / temperature - pressure * t_slope / (temperature * temperature)) / GAS,
        "energy_slope": HEAT * t_slope + GRAVITY + LATENT / 1000 * q_slope,
    }


#: Width of a slot in the logarithm of pressure, about a metre's: a metre of the table lies in one or two.
SLOT = 1.25e-4


def height_of_pressure(rows: DataFrame, table: DataFrame, pressure: str = "pressure") -> DataFrame:
    """rows with height: where the reference air has their pressure (hPa); NULL outside the table.

    A bracketing join: each metre is put under every slot of ln p that it
    touches, a row under its own, and of the few metres of a slot the one that
    brackets the row's pressure stays.  The table has a fixed number of rows.
    """
    q, exner = air.narrow(F.col("b")) / 1000, F.col("exner")
    p = 1000 * F.pow(exner, HEAT / GAS) * (1 + q / air.EPSILON)
    up = Window.orderBy("__metre")  # the metres of one sounding
    spans = table.select(F.col("metre").alias("__metre"), p.alias("__low")).withColumn("__high", F.lead("__low").over(up)).where("__high IS NOT NULL")

    def slot(of: Column) -> Column:
        return F.floor(F.log(of) / SLOT)

    spans = spans.withColumn("__slot", F.explode(F.sequence(slot(F.col("__high")), slot(F.col("__low")))))
    keyed, target = rows.withColumn("__at", slot(F.col(pressure))), F.col(pressure)
    met = keyed.join(F.broadcast(spans), (F.col("__at") == F.col("__slot")) & (target <= F.col("__low")) & (target > F.col("__high")), "left")
    step = (F.log("__low") - F.log(target)) / (F.log("__low") - F.log("__high"))
    return met.withColumn("height", F.col("__metre") + step).drop("__at", "__slot", "__metre", "__low", "__high")


def sql(top: int = 16_000) -> str:
    """The same table as SQL, up to a height."""
    values = ", ".join(f"({z}, {t}::DOUBLE, {q}::DOUBLE)" for z, t, q in LEVELS)
    lead = ", ".join(f"lead({c}) OVER (ORDER BY z) AS {c}_1" for c in ("z", "theta", "b"))
    ahead = ", ".join(f"lead({c}) OVER (ORDER BY metre) AS {c}_1" for c in ("theta", "b", "exner"))
    return f"""lv AS (SELECT z, theta, 0.5::DOUBLE * ((q + 1e-7) - 1e-14 / (q + 1e-7)) AS b FROM (VALUES {values}) l(z, theta, q)
), seg AS (SELECT *, {lead} FROM lv), pm AS (SELECT CAST(unnest(range(10, {top})) AS BIGINT) AS metre
), pt AS (SELECT metre, theta + (theta_1 - theta) * (ln(metre) - ln(z)) / (ln(z_1) - ln(z)) AS theta, b + (b_1 - b) * (ln(metre) - ln(z)) / (ln(z_1) - ln(z)) AS b FROM pm JOIN seg ON metre >= z AND metre < z_1
), pf AS (SELECT *, coalesce(-9.81::DOUBLE / (1005.7::DOUBLE * 0.5::DOUBLE * (theta + lag(theta) OVER (ORDER BY metre))), 0) AS fallen, (sqrt(first(b) OVER (ORDER BY metre) ** 2 + 1e-14) + first(b) OVER (ORDER BY metre) - 1e-7) / 1000 AS q0 FROM pt
), pe AS (SELECT metre, theta, b, pow((1014.80::DOUBLE - 1014.80::DOUBLE * (q0 / (q0 + 0.622::DOUBLE))) / 1000, 287.04::DOUBLE / 1005.7::DOUBLE) + sum(fallen) OVER (ORDER BY metre) AS exner FROM pf
), prof AS (SELECT *, {ahead} FROM pe)"""


def reference_sql(source: str) -> str:
    """CTE refd: the rows of source (with z) and the values of reference."""
    parts = ", ".join(f"{c} + ({c}_1 - {c}) * (ln(z) - ln(metre)) / (ln(metre + 1) - ln(metre)) AS ref_{c}, ({c}_1 - {c}) / (ln(metre + 1) - ln(metre)) / z AS slope_{c}" for c in ("theta", "b", "exner"))
    steps = [
        "(CASE WHEN ref_b > 0 THEN sqrt(ref_b ** 2 + 1e-14) + ref_b - 1e-7 ELSE 1e-6 END) / 1000 AS rq, ref_exner * ref_theta AS rt, 100000 * pow(ref_exner, 1005.7::DOUBLE / 287.04::DOUBLE) AS rpa, 0.002::DOUBLE * slope_b AS rqs, ref_exner * slope_theta + ref_theta * slope_exner AS rts",
        "rpa / (rt * 287.04::DOUBLE) AS rdry",
        "rdry * (1 + rq) AS rmoist, rpa * (1 + rq / 0.622::DOUBLE) AS rp, 1005.7::DOUBLE * rt + 9.81::DOUBLE * z + 2.5e6 * rq AS rh",
        "(-rmoist * 9.81::DOUBLE - 0.622::DOUBLE * rpa * rqs) / (1 + 0.622::DOUBLE * rq) AS rpas",
    ]
    ctes = [f"r0 AS (SELECT s.*, {parts} FROM {source} s JOIN prof ON metre = floor(z))"]
    ctes += [f"r{k + 1} AS (SELECT *, {step} FROM r{k})" for k, step in enumerate(steps)]
    return ", ".join(ctes) + f", refd AS (SELECT * FROM r{len(steps)})"
