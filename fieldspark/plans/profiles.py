"""Queries on the reference profile: its values, the interpolation join, and the equations that subtract it."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import air, profile
from ..operators.observations import equations
from .equations import _winds
from .tables import OBS, VAPOR, WIND, observations, registered, rounded

_REF = f"WITH {OBS}, {profile.sql()}, {profile.reference_sql('obs')}"


def _referenced(spark, sf_dir):
    return profile.with_reference(observations(spark, sf_dir), profile.metres(profile.sounding(spark)))


@registered(_REF + " SELECT event_id, round(ref_theta, 6) AS theta, round(ref_exner, 8) AS exner, round(slope_exner, 10) + 0 AS slope FROM refd")
def fn26_reference_exner(spark, sf_dir):
    """Hydrostatic integration of the reference sounding, a metre a step, at each observation's height."""
    rows = _referenced(spark, sf_dir)
    return rows.select("event_id", F.round("ref_theta", 6).alias("theta"), F.round("ref_exner", 8).alias("exner"), (F.round("slope_exner", 10) + 0.0).alias("slope"))


@registered(_REF + """ SELECT event_id, round(ref_b, 6) AS b, round(rt, 4) AS temperature, round(rdry, 6) AS dry, round(rmoist, 6) AS moist, round(rp, 2) AS pressure, round(rh, 2) AS energy,
    round(slope_b, 8) + 0 AS b_slope, round(rts, 8) + 0 AS temperature_slope, round(rpas, 6) + 0 AS pressure_slope,
    round((rpas / rt - rpa * rts / (rt * rt)) / 287.04::DOUBLE, 10) + 0 AS dry_slope, round((-rmoist * 9.81::DOUBLE / rt - rp * rts / (rt * rt)) / 287.04::DOUBLE, 10) + 0 AS moist_slope,
    round(1005.7::DOUBLE * rts + 9.81::DOUBLE + 2500 * rqs, 6) + 0 AS energy_slope FROM refd""")
def fn25_reference_values(spark, sf_dir):
    """Values and slopes of the reference air at each observation's height."""
    places = {"b": 6, "temperature": 4, "dry": 6, "moist": 6, "pressure": 2, "energy": 2, "b_slope": 8, "temperature_slope": 8, "pressure_slope": 6, "dry_slope": 10, "moist_slope": 10, "energy_slope": 6}
    values = profile.reference(F.col("z"))
    return _referenced(spark, sf_dir).select("event_id", *[(F.round(values[n], k) + 0.0).alias(n) for n, k in places.items()])


@registered(_REF + " SELECT event_id, round(temperature - rt, 4) + 0 AS warmer, round(pressure * 100 - rp, 1) + 0 AS higher FROM refd")
def jn03_departures(spark, sf_dir):
    """Observations less the reference air at their height: an interpolation join in ln z, as an equi-join on the metre."""
    ref = profile.reference(F.col("z"))
    rows = _referenced(spark, sf_dir)
    return rows.select("event_id", (F.round(F.col("temperature") - ref["temperature"], 4) + 0.0).alias("warmer"), (F.round(F.col("pressure") * 100 - ref["pressure"], 1) + 0.0).alias("higher"))


@registered(f"""WITH {OBS}, {profile.sql(40_000)}, lp AS (
        SELECT metre, 1000 * pow(exner, 1005.7::DOUBLE / 287.04::DOUBLE) * (1 + (sqrt(b * b + 1e-14) + b - 1e-7) / 1000 / 0.622::DOUBLE) AS p FROM prof WHERE theta_1 IS NOT NULL AND metre < 39999
    ), ld AS (SELECT metre, p, lead(p) OVER (ORDER BY metre) AS p_1 FROM lp)
    SELECT event_id, round(metre + (ln(p) - ln(pressure)) / (ln(p) - ln(p_1)), 3) AS height FROM obs LEFT JOIN ld ON pressure <= p AND pressure > p_1""")
def fn16_reference_height(spark, sf_dir):
    """Pressure to height on the reference profile."""
    table = profile.metres(profile.sounding(spark)).where("metre < 39999")
    return profile.height_of_pressure(observations(spark, sf_dir), table).select("event_id", F.round("height", 3).alias("height"))


#: Error of each variable, by instrument: horizontal wind, vertical wind, temperature, ratio, density.
ERRORS = {
    "prj01_dropsonde_equations": ("view", (1.0, 2.0, 0.5, 0.3, 0.005)),
    "prj02_flight_level_equations": ("click", (1.0, 1.5, 0.8, 0.4, 0.008)),
    "prj13_station_equations": ("purchase", (1.2, 2.0, 0.6, 0.4, 0.006)),
    "prj15_model_equations": ("signup", (1.0, 1.0, 0.9, 0.5, 0.01)),
}


def _six_sql(kind: str, errors) -> str:
    wind, up, warm, wet, dense = errors
    values = [(0, "rho * u", wind), (1, "rho * v", wind), (2, "rho * w", up), (3, "temperature - rt", warm), (4, "0.5 * ((q + 1e-7) - 1e-14 / (q + 1e-7)) - ref_b", wet), (5, "(dry - rdry) * 100", dense)]
    each = " UNION ALL ".join(f"SELECT event_id, {k} AS variable, {v} AS value, 1 / {e}::DOUBLE AS inverse_error FROM m6" for k, v, e in values)
    return f"""{_REF}, d6 AS (SELECT *, (event_id % 11 - 5) / 2.0::DOUBLE AS w, {WIND}, {VAPOR} AS e FROM refd WHERE event_type = '{kind}'
    ), e6 AS (SELECT *, (pressure - e) * 100 / (287 * temperature) AS dry, 622 * e / (pressure - e) AS q FROM d6
    ), m6 AS (SELECT *, dry * (1 + q / 1000) AS rho FROM e6), eq AS ({each})
    SELECT event_id, CAST(variable AS INTEGER) AS variable, round(value, 4) + 0 AS value, round(inverse_error, 4) AS inverse_error FROM eq WHERE value IS NOT NULL"""


def _six(name: str):
    kind, errors = ERRORS[name]

    def query(spark, sf_dir):
        c, ref, e = F.col, profile.reference(F.col("z")), air.vapor_pressure(F.col("dewpoint"))
        rows = _winds(_referenced(spark, sf_dir).where(F.col("event_type") == kind))
        rows = rows.withColumns({
            "w": (c("event_id") % 11 - 5) / 2.0, "ratio": air.mixing_ratio(e, c("pressure")), "dry": air.dry_density(c("pressure") - e, c("temperature")),
            "density": air.moist_density(c("pressure"), c("temperature"), c("dewpoint")), "t_ref": ref["temperature"], "q_ref": ref["b"], "dry_ref": ref["dry"],
        })
        return rounded(equations(rows, dict(zip(("wind", "w", "temperature", "ratio", "density"), errors, strict=True)), ("event_id",)), "event_id", "variable")

    query.__name__ = query.__qualname__ = name
    query.__doc__ = "The six equations of an instrument, less the reference profile."
    return registered(_six_sql(kind, errors))(query)


for _name in ERRORS:
    _six(_name)


@registered(_REF + f""", s20 AS (SELECT *, {WIND}, {VAPOR} AS e FROM refd), t20 AS (SELECT *, (pressure - e) * 100 / (287 * temperature) AS dry, 622 * e / (pressure - e) AS q FROM s20)
    SELECT event_id, second, round(x, 4) + 0 AS x, round(y, 4) + 0 AS y, round(ln(z), 6) AS log_z, round(dry * (1 + q / 1000) * u, 4) + 0 AS rho_u, round(dry * (1 + q / 1000) * v, 4) + 0 AS rho_v,
           round(temperature - rt, 4) + 0 AS warmer, round(0.5 * ((q + 1e-7) - 1e-14 / (q + 1e-7)) - ref_b, 4) + 0 AS wetter, round((dry - rdry) * 100, 4) + 0 AS denser FROM t20""")
def prj20_background_samples(spark, sf_dir):
    """Background samples as departures from the reference state."""
    c, ref, e = F.col, profile.reference(F.col("z")), air.vapor_pressure(F.col("dewpoint"))
    rows, dry, q = _winds(_referenced(spark, sf_dir)), air.dry_density(c("pressure") - e, c("temperature")), air.mixing_ratio(e, c("pressure"))
    rho = dry * (1 + q / 1000)
    rows = rows.select(
        "event_id", "second", "x", "y", F.round(F.log("z"), 6).alias("log_z"), (rho * c("u")).alias("rho_u"), (rho * c("v")).alias("rho_v"),
        (c("temperature") - ref["temperature"]).alias("warmer"), (air.widen(q) - ref["b"]).alias("wetter"), ((dry - ref["dry"]) * 100).alias("denser"),
    )
    return rounded(rows, "event_id", "second", "log_z")
