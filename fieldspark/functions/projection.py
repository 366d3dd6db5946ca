"""Transverse Mercator by the Krüger series in the third flattening (Karney 2011), as column expressions.

Good to well below a millimetre within some thousand kilometres of the
central meridian.
"""

from __future__ import annotations

from math import sqrt

from pyspark.sql import Column
from pyspark.sql import functions as F

RADIUS, FLATTENING, SCALE = 6_378_137.0, 1 / 298.257223563, 0.9996
N = FLATTENING / (2 - FLATTENING)
RECTIFYING = RADIUS / (1 + N) * (1 + N**2 / 4 + N**4 / 64 + N**6 / 256)

# fixed values: the published series, powers of N ascending from the first that is not zero
FORWARD = [
    (1 / 2, -2 / 3, 5 / 16, 41 / 180, -127 / 288, 7891 / 37800),
    (13 / 48, -3 / 5, 557 / 1440, 281 / 630, -1983433 / 1935360),
    (61 / 240, -103 / 140, 15061 / 26880, 167603 / 181440),
    (49561 / 161280, -179 / 168, 6601661 / 7257600),
]
REVERSE = [
    (1 / 2, -2 / 3, 37 / 96, -1 / 360, -81 / 512, 96199 / 604800),
    (1 / 48, 1 / 15, -437 / 1440, 46 / 105, -1118711 / 3870720),
    (17 / 480, -37 / 840, -209 / 4480, 5569 / 90720),
    (4397 / 161280, -11 / 504, -830251 / 7257600),
]
LATITUDE = [
    (2, -2 / 3, -2, 116 / 45, 26 / 45, -2854 / 675),
    (7 / 3, -8 / 5, -227 / 45, 2704 / 315, 2323 / 945),
    (56 / 15, -136 / 35, -1262 / 105, 73814 / 2835),
    (4279 / 630, -332 / 35, -399572 / 14175),
    (4174 / 315, -144838 / 6237),
    (601676 / 22275,),
]


def _terms(series: list[tuple]) -> list[float]:
    return [sum(c * N ** (j + 1 + k) for k, c in enumerate(row)) for j, row in enumerate(series)]


def forward(latitude: Column, longitude: Column, central: Column | float = 0.0) -> tuple[Column, Column]:
    """x and y in metres of a place in degrees."""
    sine, lam = F.sin(F.radians(latitude)), F.radians(longitude - central)
    e = 2 * sqrt(N) / (1 + N)
    t = F.sinh(F.atanh(sine) - e * F.atanh(e * sine))
    xi = F.atan2(t, F.cos(lam))
    eta = F.atanh(F.sin(lam) / F.sqrt(1 + t * t))
    x, y = eta, xi
    for j, a in enumerate(_terms(FORWARD), 1):
        x = x + a * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
        y = y + a * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
    return SCALE * RECTIFYING * x, SCALE * RECTIFYING * y


def reverse(x: Column, y: Column, central: Column | float = 0.0) -> tuple[Column, Column]:
    """Latitude and longitude in degrees of a place in metres."""
    xi, eta = y / (SCALE * RECTIFYING), x / (SCALE * RECTIFYING)
    p, q = xi, eta
    for j, b in enumerate(_terms(REVERSE), 1):
        p = p - b * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
        q = q - b * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
    chi = F.asin(F.sin(p) / F.cosh(q))
    latitude = chi
    for j, d in enumerate(_terms(LATITUDE), 1):
        latitude = latitude + d * F.sin(2 * j * chi)
    return F.degrees(latitude), F.degrees(F.atan2(F.sinh(q), F.cos(p))) + central
