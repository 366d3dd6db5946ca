"""Radar gates, as column expressions.  Reflectivities in dBZ, heights in metres, angles in degrees."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH = 6_371_000.0


def linear(dbz: Column) -> Column:
    return F.pow(F.lit(10.0), dbz * 0.1)


def beam_height(distance: Column, elevation: Column) -> Column:
    return F.sqrt(distance * distance + EARTH * EARTH + 2 * distance * EARTH * F.sin(F.radians(elevation))) - EARTH


def _by_phase(dbz: Column, rain: Column, ice: Column, mixed_dbz: float, rain_dbz: float, sure_dbz: float) -> Column:
    share = (dbz - mixed_dbz) / (rain_dbz - mixed_dbz)
    return F.when((dbz > mixed_dbz) & (dbz <= rain_dbz), rain * share + ice * (1 - share)).when(dbz > sure_dbz, rain).otherwise(ice)


def _by_height(height: Column, rain: Column, ice: Column, freezing: float, melting: float) -> Column:
    blend = rain * (freezing + melting - height) / melting + ice * (height - freezing) / melting
    return F.when(height < freezing, rain).when(height > freezing + melting, ice).otherwise(blend)


def fall_speed(dbz: Column, height: Column, density_ratio: Column, freezing: float, melting: float = 1000.0, mixed_dbz: float = 20.0, rain_dbz: float = 30.0) -> Column:
    """Terminal fall speed, negative downward; density_ratio: surface to local."""
    z, thin = linear(dbz), F.pow(density_ratio, F.lit(0.45))
    snow, rain = -thin * 0.817 * F.pow(z, F.lit(0.063)), -thin * 2.6 * F.pow(z, F.lit(0.107))
    return _by_height(height, rain, _by_phase(dbz, rain, snow, mixed_dbz, rain_dbz, rain_dbz), freezing, melting)


def water_content(dbz: Column, height: Column, freezing: float, melting: float = 1000.0, mixed_dbz: float = 20.0, rain_dbz: float = 30.0) -> Column:
    z = linear(dbz)
    rain, ice = F.pow(z / 14630.0, F.lit(0.6905)), F.pow(z / 670.0, F.lit(0.5587))
    # the upper threshold of ice is fixed, whatever rain_dbz says
    return _by_height(height, rain, _by_phase(dbz, rain, ice, mixed_dbz, rain_dbz, 30.0), freezing, melting)


def doppler_weights(azimuth: Column, elevation: Column) -> tuple[Column, Column, Column]:
    a, e = F.radians(azimuth), F.radians(elevation)
    return F.sin(a) * F.cos(e), F.cos(a) * F.cos(e), F.sin(e)


def folded(velocity: Column, low: float, high: float) -> Column:
    """A velocity as a radar with this Nyquist interval shows it."""
    return F.pmod(velocity - low, F.lit(high - low)) + low


def scaled(raw: Column, scale: Column, missing: int) -> Column:
    """Stored 16-bit values in units; the flag of missing ones is NULL."""
    return F.when(raw != missing, raw / scale)


def earth_angles(roll: Column, pitch: Column, heading: Column, drift: Column, rotation: Column, tilt: Column) -> tuple[Column, Column]:
    """Azimuth (0 to 360) and elevation of an airborne beam relative to the earth; a missing angle counts as 0.

    The beam's unit vector in the aircraft's track frame, by the published
    coordinate rotations, then turned by the track's direction.
    """
    r, p, h, d, t, a = (F.radians(F.coalesce(F.nanvl(x, F.lit(0.0)), F.lit(0.0))) for x in (roll, pitch, heading, drift, rotation, tilt))
    up, side, ahead = F.cos(t + r) * F.cos(a), F.sin(t + r) * F.cos(a), F.sin(a)
    level, lifted = ahead * F.cos(p) - up * F.sin(p), up * F.cos(p) + ahead * F.sin(p)
    x, y = side * F.cos(d) - level * F.sin(d), side * F.sin(d) + level * F.cos(d)
    azimuth = F.degrees(F.atan2(x, y) + h + d)
    return F.pmod(azimuth, F.lit(360.0)), F.degrees(F.asin(lifted))


def measured_spread(width: Column, signal_to_noise: Column, interval: float, wavelength: float, looks: int) -> tuple[Column, Column]:
    """Standard deviations of reflectivity (dB) and velocity as a radar measures them, by spectrum width, signal to noise (dB), pulse interval (s), wavelength (m) and number of looks.

    The published error model of pulses of which some are independent: noise
    and decorrelation between pulses widen both.
    """
    snr = linear(signal_to_noise)
    likeness = F.exp(-8.0 * F.pow(math.pi * interval / wavelength * width, F.lit(2.0)))
    noise = F.pow(1 / snr, F.lit(2.0)) + 2 / snr
    square = likeness * likeness
    power = (1 + square + noise) / (2.0 * looks)
    speed = wavelength * wavelength / (32 * (math.pi * interval) ** 2) / square * (1 - square + noise) / looks
    return 10 * F.log10(1 + F.sqrt(power)), F.sqrt(speed)
