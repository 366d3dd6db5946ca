"""Observation files in netCDF-3, by kind: which variables are read, and the columns that they become.

Times are set for every kind.  Missing is NULL.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.air import T0, dewpoint_of_humidity
from .netcdf import header_of, read_netcdf


@dataclass(frozen=True)
class Kind:
    schema: str
    dims: str
    columns: Callable[[], dict[str, Column]]


def _told(name: str) -> Column:
    """-9999 and what is beyond 1e32, and NaN, are missing."""
    c = F.col(name)
    return F.when((c != -9999) & (F.abs(c) < 1e32) & ~F.isnan(c), c)


def _part(k: int) -> Column:
    return F.split(F.regexp_extract("file", r"([^/]*)$", 1), r"[_.]")[k]


def _named_start(day: int, clock: int) -> Column:
    """Seconds of the day and the clock in a file's name."""
    return F.unix_seconds(F.to_timestamp(F.concat(_part(day), F.rpad(_part(clock), 6, "0")), "yyyyMMddHHmmss"))


def _station() -> dict[str, Column]:
    return {
        "second": F.col("observationTime").cast("long"), "latitude": _told("latitude"), "longitude": _told("longitude"), "altitude": _told("elevation"), "temperature": _told("temperature"),
        "dewpoint": _told("dewpoint"), "direction": _told("windDir"), "speed": _told("windSpeed"), "pressure": _told("stationPressure") / 100,
    }


def _sonde(height: float, warm: str, start: Callable[[], Column]) -> Callable[[], dict[str, Column]]:
    def columns() -> dict[str, Column]:
        t = _told(warm) + T0
        return {
            "second": start() + F.col("time").cast("long"), "latitude": _told("lat"), "longitude": _told("lon"), "altitude": _told("alt") * height, "temperature": t,
            "dewpoint": dewpoint_of_humidity(_told("rh"), t), "direction": _told("wdir"), "speed": _told("wspd"), "pressure": _told("pres"),
        }

    return columns


def _profile() -> dict[str, Column]:
    return {
        "second": (F.col("base_time") + F.col("time_offset")).cast("long"), "latitude": _told("lat"), "longitude": _told("lon"), "altitude": _told("alt") + _told("height"),
        "temperature": _told("ambientTemp"), "dewpoint": _told("dewpointTemp"), "pressure": _told("pressure"),
    }


def _background() -> dict[str, Column]:
    def calm(name: str) -> Column:
        return F.coalesce(F.nanvl(F.col(name), F.lit(0.0)), F.lit(0.0))

    return {
        "z": F.col("z0"), "y": F.col("y0"), "x": F.col("x0"), "u": calm("U"), "v": calm("V"), "w": calm("W"), "reflectivity": F.coalesce(F.nanvl(F.col("DBZ"), F.lit(-35.0)), F.lit(-35.0)),
    }


def _errors() -> dict[str, Column]:
    return {"z": F.col("z0"), "y": F.col("y0"), "x": F.col("x0"), **{k: F.when(~F.isnan(f"{k.upper()}_std"), F.col(f"{k.upper()}_std")) for k in "uvw"}}


def _gate() -> dict[str, Column]:
    return {
        "second": F.col("time").cast("long"), "azimuth": F.col("azimuth"), "elevation": F.col("elevation"), "distance": F.col("range"), "latitude": F.col("latitude"), "longitude": F.col("longitude"),
        "altitude": F.col("altitude"), "reflectivity": _told("DBZ"), "velocity": _told("VEL"), "width": _told("WIDTH"),
    }


def _doubles(names: str) -> str:
    return ", ".join(f"{n} double" for n in names.split())


_SONDE = "file string, " + _doubles("lat lon alt time rh wdir wspd pres ")
KINDS = {
    "mesonet": Kind(_doubles("latitude longitude elevation observationTime temperature dewpoint windDir windSpeed stationPressure"), "recNum", _station),
    "classnc": Kind(_SONDE + ", temp double", "time", _sonde(1000.0, "temp", lambda: _named_start(1, 2))),
    "ict": Kind(_SONDE + ", tdry double", "time", _sonde(1.0, "tdry", lambda: _named_start(5, 6))),
    "aeri": Kind(_doubles("lat lon alt height base_time time_offset ambientTemp dewpointTemp pressure"), "time,pres_level", _profile),
    "fractl": Kind(_doubles("time z0 y0 x0 U V W DBZ"), "time,z0,y0,x0", _background),
    "fractl_errors": Kind(_doubles("time z0 y0 x0 U_std V_std W_std"), "time,z0,y0,x0", _errors),
    "cfradial": Kind(_doubles("time range azimuth elevation latitude longitude altitude DBZ VEL WIDTH"), "time,range", _gate),
}


def read_observations(spark: SparkSession, path: str, kind: str, **options: object) -> DataFrame:
    """The rows of all files of a kind; the sondes' start is in their files' names."""
    k = KINDS[kind]
    return read_netcdf(spark, path, k.schema, dims=k.dims, **options).select(*[c.alias(n) for n, c in k.columns().items()])


def grid_of(path: str) -> dict[str, object]:
    """The global attributes of a background file, by which its grid is set."""
    return header_of(path).attributes
