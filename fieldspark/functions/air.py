"""Moist air, as column expressions: pressures in hPa, temperatures in K, mixing ratios in g/kg."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values
E0, T0, EPSILON, GAS, HEAT, GRAVITY = 6.1078, 273.15, 0.622, 287.0, 1005.7, 9.81
ICE_A, ICE_B = 5.0065, 19.83923
BIAS = 1e-7


def vapor_pressure(dewpoint: Column) -> Column:
    return E0 * F.exp(17.2694 * (1.0 - 237.3 / (dewpoint - T0 + 237.3)))


def saturation_pressure(temperature: Column) -> Column:
    c = temperature - T0
    return 6.112 * F.exp(17.62 * c / (243.12 + c))


def saturation_pressure_log(temperature: Column) -> Column:
    """The other formula, of virtual temperature and of humidity."""
    return E0 * F.exp(ICE_A * F.log(T0 / temperature)) * F.exp((ICE_A + ICE_B) * (1 - T0 / temperature))


def mixing_ratio(vapor: Column, pressure: Column) -> Column:
    return F.try_divide(1000.0 * EPSILON * vapor, pressure - vapor)


def dry_density(pressure: Column, temperature: Column) -> Column:
    return pressure * 100 / (GAS * temperature)


def moist_density(pressure: Column, temperature: Column, dewpoint: Column) -> Column:
    e = vapor_pressure(dewpoint)
    return dry_density(pressure - e, temperature) * (1 + mixing_ratio(e, pressure) / 1000)


def virtual_temperature(temperature: Column, pressure: Column) -> Column:
    return temperature / (1 - saturation_pressure_log(temperature) / pressure * (1 - EPSILON))


def static_energy(temperature: Column, ratio: Column, altitude: Column) -> Column:
    return HEAT * temperature + 1e3 * (2.501 - 0.00237 * (temperature - T0)) * ratio + GRAVITY * altitude


def dewpoint_of_humidity(humidity: Column, temperature: Column) -> Column:
    """NULL unless the relative humidity lies in (0, 101)."""
    u = F.log(saturation_pressure_log(temperature) * humidity / 100 / E0)
    return F.when((humidity > 0) & (humidity < 101), 237.3 * u / (17.2694 - u) + T0)


def widen(q: Column) -> Column:
    """The biased hyperbolic transform that keeps a moisture non-negative."""
    return 0.5 * ((q + BIAS) - BIAS * BIAS / (q + BIAS))


def narrow(b: Column) -> Column:
    """Its quasi-inverse; 1e-6 where b is not positive."""
    return F.when(b > 0, F.sqrt(b * b + BIAS * BIAS) + b - BIAS).otherwise(1e-6)


def analysed(temperature: Column, ratio: Column, density: Column) -> dict[str, Column]:
    """Derived quantities of an analysis point from temperature, mixing ratio and density of dry air."""
    vapor = temperature * density * ratio / 1000 * 461.0 / 100.0
    dry = temperature * density * 287.0 / 100.0
    full = F.exp(-6096.9385 / temperature + 16.635794 - 2.711193e-2 * temperature + 1.673952e-5 * temperature * temperature + 2.433502 * F.log(temperature))
    pressure = dry + vapor
    theta = temperature * F.pow(1000 / pressure, 0.2854 * (1 - 0.00028 * ratio))
    most = 622 * full / dry

    def lifted(e: Column) -> Column:
        return 2840 / (3.5 * F.log(temperature) - F.log(e) - 4.805) + 55.0

    def equivalent(e: Column, q: Column) -> Column:
        return theta * F.exp((3.376 / lifted(e) - 0.00254) * q * (1 + 0.00081 * q))

    e = F.least(vapor, full)
    log_e = F.log(e / E0)
    return {
        "pressure": pressure,
        "theta": theta,
        "theta_e": equivalent(vapor, ratio),
        "theta_es": equivalent(full, most),
        "humidity": F.least(100 * vapor / full, F.lit(100.0)),
        "dewpoint": 237.3 * log_e / (17.2694 - log_e) + T0,
    }


def departures(temperature: Column, ratio: Column, density: Column, altitude: Column, reference_pressure: Column, reference_energy: Column) -> dict[str, Column]:
    """What the analysis says against the reference air (Pa, J/kg), its condensation level, and moisture no more than saturation allows."""
    # fixed values
    vapor = temperature * density * ratio / 1000 * 461.0 / 100.0
    dry = temperature * density * 287.0 / 100.0
    full = F.exp(-6096.9385 / temperature + 16.635794 - 2.711193e-2 * temperature + 1.673952e-5 * temperature * temperature + 2.433502 * F.log(temperature))
    most = 622 * full / dry
    energy = HEAT * temperature + 2.501e3 * ratio + GRAVITY * altitude
    return {
        "higher": dry + vapor - reference_pressure / 100, "energy": energy, "energy_above": energy - reference_energy, "lifted": 2840 / (3.5 * F.log(temperature) - F.log(vapor) - 4.805) + 55.0,
        "saturated": most, "ratio": F.when(100 * vapor / full > 100, most).otherwise(ratio),
    }


def pressure_slope(temperature: Column, density: Column, ratio: Column, t_slope: Column, d_slope: Column, q_slope: Column) -> Column:
    """A derivative of the analysis' pressure (hPa) along an axis, from those of temperature, density of dry air and mixing ratio."""
    dry = (t_slope * density + d_slope * temperature) * 287.0 / 100
    wet = (t_slope * density * ratio / 1000 + (d_slope * ratio + q_slope * density) * temperature / 1000) * 461.0 / 100
    return dry + wet


# fixed values of the formula library: exponents of dry air and of moist
KAPPA, KAPPA_MOIST = 0.28537338, 0.00028


def potential_temperature(temperature: Column, pressure: Column) -> Column:
    return temperature * F.pow(1000 / pressure, KAPPA)


def condensation_temperature(temperature: Column, dewpoint: Column) -> Column:
    """NULL where the dew point is above the temperature."""
    return F.when(dewpoint <= temperature, 1 / (1 / (dewpoint - 56.0) + F.log(temperature / dewpoint) / 800.0) + 56.0)


def saturation_temperature(pressure: Column, ratio: Column) -> Column:
    """At which air of a pressure is saturated with a mixing ratio."""
    e = pressure * ratio / (1000 * EPSILON + ratio)
    return T0 * ICE_A / (ICE_A - ICE_B + F.sqrt(ICE_B * ICE_B + 2 * ICE_A * F.log(E0 / e)))


def equivalent_temperature(temperature: Column, dewpoint: Column, pressure: Column) -> Column:
    w = mixing_ratio(saturation_pressure_log(dewpoint), pressure)
    theta = temperature * F.pow(1000 / pressure, KAPPA * (1 - KAPPA_MOIST * w))
    return theta * F.exp((3.376 / condensation_temperature(temperature, dewpoint) - 0.00254) * w * (1 + 0.00081 * w))


def condensation_pressure(temperature: Column, dewpoint: Column, pressure: Column, rounds: int = 5) -> Column:
    """Where air lifted without exchange of heat is saturated with what it holds; NULL where the dew point is above the temperature.

    At a pressure p, saturation with the held vapor is at the temperature of
    saturation_temperature, and the lifted air has theta (p/1000)^kappa; both
    meet once.  Their difference in ln p is concave, so Newton's steps from
    the condensation temperature's own pressure settle within a few rounds.
    """
    w, theta = mixing_ratio(saturation_pressure_log(dewpoint), pressure), potential_temperature(temperature, pressure)
    start = F.log(pressure) + F.log(condensation_temperature(temperature, dewpoint) / temperature) / KAPPA
    inputs = F.array(F.struct(start.alias("x"), w.alias("w"), theta.alias("theta")))

    def step(s: Column) -> Column:
        p = F.exp(s["x"])
        root = F.sqrt(ICE_B * ICE_B + 2 * ICE_A * F.log(E0 / (p * s["w"] / (1000 * EPSILON + s["w"]))))
        wet, dry = T0 * ICE_A / (ICE_A - ICE_B + root), s["theta"] * F.exp(KAPPA * F.log(p / 1000))
        slope = wet * wet / (T0 * root) - KAPPA * dry
        return F.struct((s["x"] - (wet - dry) / slope).alias("x"), s["w"].alias("w"), s["theta"].alias("theta"))

    # a row's own few steps, each from a value and not from its expression
    for _ in range(rounds):
        inputs = F.transform(inputs, step)
    return F.exp(inputs[0]["x"])
