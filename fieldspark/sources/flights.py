"""Text files whose lines mean something only with the header above them: one file, one flight or sounding.

Files are read line by line, each line with its number, by as many tasks as
they have blocks.  What the header says is one row a file (the flight's start,
where its data begin and end), joined to the lines; all with built-in
expressions.  Missing is NULL.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.air import T0, dewpoint_of_humidity
from .lines import numbered, words

KNOT = 0.514  # metres a second, as the format's readers take it
Fields = Callable[[int], Column]


def _number(text: Column, *missing: float) -> Column:
    value = text.cast("double")
    for m in missing:
        value = F.when(value != m, value)
    return value


def _kelvin(celsius: Column) -> Column:
    return celsius + T0


def _clock(text: Column) -> Column:
    """Seconds of hhmmss; hours past 23 run on into the next day."""
    h, m, s = (F.substring(text, k, 2).cast("long") for k in (1, 3, 5))
    return h * 3600 + m * 60 + s


def degrees_of(text: Column, whole: int, negative: str) -> Column:
    """Degrees of d..dmmH: whole digits of degrees, two of minutes, then the hemisphere."""
    size = F.substring(text, 1, whole).cast("double") + F.substring(text, whole + 1, 2).cast("double") / 60
    return F.when(F.substring(text, whole + 3, 1) == negative, -size).otherwise(size)


@dataclass(frozen=True)
class Flight:
    """Of a file's lines, as aggregates: its start, its first line of data, the line where they end; and the columns of one."""

    start: Column
    first: Column
    end: Column
    columns: Callable[[Fields], dict[str, Column]]


def _first_line(prefix: str) -> Column:
    starts = F.col("value").startswith(prefix)
    return F.min_by(F.when(starts, F.col("value")), F.when(starts, F.col("number")))


def _line(number: int) -> Column:
    return F.min(F.when(F.col("number") == number, F.col("value")))


def _number_of(found: Column) -> Column:
    return F.min(F.when(found, F.col("number")))


def _sonde(f: Fields) -> dict[str, Column]:
    """The first field is the second since launch; dew point follows from humidity."""
    t = _kelvin(_number(f(5), -999.0))
    return {
        "second": F.col("start") + f(0).cast("double").cast("long"), "latitude": _number(f(15), -999.0), "longitude": _number(f(14), -999.0), "altitude": _number(f(13), -999.0),
        "pressure": _number(f(4), -999.0), "temperature": t, "dewpoint": dewpoint_of_humidity(_number(f(7), -999.0), t), "direction": _number(f(11), -999.0), "speed": _number(f(10), -999.0),
    }


def _flight_level(f: Fields) -> dict[str, Column]:
    """Longitudes are west; a wind counts where its speed is not negative."""
    speed = _number(f(10))
    return {
        "second": F.col("start") + _clock(f(0)), "latitude": _number(f(1)), "longitude": -_number(f(2)), "altitude": _number(f(7)), "pressure": _number(f(8)),
        "temperature": _kelvin(_number(f(11), -999.0, -32767.0)), "dewpoint": _kelvin(_number(f(12), -999.0, -32767.0)),
        "direction": F.when(speed >= 0, _number(f(9))), "speed": F.when(speed >= 0, speed), "w": _number(f(16), -999.0, -32767.0),
    }


def _recon(f: Fields) -> dict[str, Column]:
    """Slashes are missing; pressures lose their leading 1, temperatures carry their sign in front, winds are in knots."""

    def told(text: Column) -> Column:
        return F.when(~text.contains("/"), text)

    def signed(text: Column) -> Column:
        return _kelvin(told(text).cast("double") / 10)

    p = told(f(3)).cast("double")
    return {
        "second": F.col("start") + _clock(f(0)), "latitude": degrees_of(f(1), 2, "S"), "longitude": degrees_of(f(2), 3, "W"), "altitude": told(f(4)).cast("double"),
        "pressure": F.when(p < 1000, p + 10000).otherwise(p) / 10, "temperature": signed(f(6)), "dewpoint": signed(f(7)),
        "direction": told(F.substring(f(8), 1, 3)).cast("double"), "speed": told(f(9)).cast("double") * KNOT,
    }


def _winds(f: Fields) -> dict[str, Column]:
    """Satellite winds have no altitude: profile.height_of_pressure gives it."""
    return {"second": F.unix_seconds(F.to_timestamp(F.concat(f(2), f(3)), "yyyyMMddHHmm")), "latitude": _number(f(4)), "longitude": -_number(f(5)), "pressure": _number(f(6)), "speed": _number(f(7)), "direction": _number(f(8))}


def _day(text: Column) -> Column:
    return F.unix_seconds(F.to_timestamp(text, "yyyyMMdd"))


def _launch(line: Column) -> Column:
    return F.unix_seconds(F.to_timestamp(F.concat_ws(" ", F.substring(line, 44, 12), F.substring(line, 58, 8)), "yyyy, MM, dd HH:mm:ss"))


def _flights() -> dict[str, Flight]:
    none, value = F.lit(None).cast("long"), F.col("value")
    ends = (F.col("number") > 0) & ((value == "") | (value == "$$"))
    return {
        "eol": Flight(_launch(_first_line("UTC")), _number_of(value.startswith("------")) + 1, none, _sonde),
        "1sec": Flight(_day(F.substring(F.split(_line(0), r"\s+")[1], 1, 8)), F.lit(4), none, _flight_level),
        "hdob": Flight(_day(F.element_at(F.split(F.trim(_line(0)), r"\s+"), -1)), F.lit(1), _number_of(ends), _recon),
        "cimss": Flight(none, F.lit(1), none, _winds),
    }


def read_flights(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """The rows of all files of a kind below path, typed."""
    flight, lines = _flights()[kind], numbered(spark, path)
    told = lines.groupBy("file").agg(flight.start.alias("start"), flight.first.alias("first"), flight.end.alias("end"))
    held = lines.join(told, "file").where((F.col("number") >= F.col("first")) & (F.col("end").isNull() | (F.col("number") < F.col("end"))) & (F.trim("value") != ""))
    held = held.select("start", words().alias("f"))
    return held.select(*[c.alias(n) for n, c in flight.columns(lambda k: F.col("f")[k]).items()])


def read_radials(spark: SparkSession, path: str, header: int = 8, values_a_line: int = 10) -> DataFrame:
    """Gates of radials that span many lines: a line of the ray (second, place, angles), then its velocities, ten a line.

    The header gives the number of gates (4th line), the first radius and the
    resolution, both in metres (5th and 6th).  So the numbers of lines tell
    which belong together, across the borders of blocks; a radial's lines meet
    in one small group.  Velocities are tenths of metres a second; missing
    ones have no row.  The format holds no reflectivity: it counts as 10 dBZ.
    """
    lines, per = numbered(spark, path), F.col("size")
    gates, first, step = (F.trim(_line(k)) for k in (3, 4, 5))
    told = lines.groupBy("file").agg((F.ceil(gates.cast("int") / values_a_line) + 1).alias("size"), first.cast("double").alias("radius"), step.cast("double").alias("step"))
    at = F.col("number") - header
    held = lines.join(told, "file").where(at >= 0)
    held = held.select("file", "radius", "step", F.floor(at / per).alias("radial"), (at % per).alias("part"), words().alias("f"))
    held = held.groupBy("file", "radial").agg(
        F.first("radius").alias("radius"), F.first("step").alias("step"), F.min(F.when(F.col("part") == 0, F.col("f"))).alias("ray"),
        F.array_sort(F.collect_list(F.when(F.col("part") > 0, F.struct("part", "f")))).alias("parts"),
    ).where(F.col("ray")[0] != "")
    ray = {n: F.col("ray")[k].cast("double") for k, n in enumerate(("second", "latitude", "longitude", "altitude", "angle", "elevation"))}
    rows = held.select("radius", "step", *[c.alias(n) for n, c in ray.items()], F.posexplode(F.flatten(F.transform("parts", lambda p: p["f"]))).alias("gate", "text"))
    velocity = F.col("text").cast("double")
    return rows.where(velocity != -8888.0).select(
        F.col("second").cast("long").alias("second"), (90 - F.col("angle")).alias("azimuth"), "elevation", (F.col("radius") + (F.col("gate") + 1) * F.col("step")).alias("distance"),
        "latitude", "longitude", "altitude", F.lit(10.0).alias("reflectivity"), (velocity / 10).alias("velocity"),
    )


def write_flights(lines: DataFrame, path: str) -> None:
    """Lines (name, number, value) as one text file for each name, in the order of numbers; a file is written as a stream by one task."""
    ordered = lines.repartition("name").sortWithinPartitions("name", "number")
    ordered.select("name", "value").write.partitionBy("name").text(path)
