"""Observation files as DataFrames: one declared layout for each kind of text file.

A layout names the fields of a line by position and gives the columns as
expressions of them; Spark splits files, prunes columns and, with
``stream=True``, follows a folder with the same expressions.  Missing is NULL.
A line whose fields do not parse fails the job, as it would fail the analysis.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.air import T0

Fields = Callable[[int], Column]


def _kelvin(celsius: Column, least: float = -100.0) -> Column:
    return F.when(celsius >= least, celsius + T0)


def _known(value: Column, missing: float = -999.0) -> Column:
    return F.when(value != missing, value)


def _time(text: Column, pattern: str) -> Column:
    return F.unix_seconds(F.to_timestamp(text, pattern))


def _numbers(*names: str, first: int = 1) -> Callable[[Fields], dict[str, Column]]:
    return lambda f: {n: _known(f(first + k).cast("double")) for k, n in enumerate(names)}


@dataclass(frozen=True)
class Layout:
    separator: str
    columns: Callable[[Fields], dict[str, Column]]
    skip: str | None = None  # lines that hold this are none


def _insitu(f: Fields) -> dict[str, Column]:
    plain = _numbers("latitude", "longitude", "altitude", "pressure")(f)
    return {
        "second": _time(f(0), "yyyy-MM-dd'T'HH:mm:ss"), **plain, "temperature": _kelvin(f(5).cast("double")), "dewpoint": _kelvin(f(6).cast("double")),
        **_numbers("direction", "speed", "w", first=7)(f),
    }


def _timed(pattern: str, *names: str) -> Callable[[Fields], dict[str, Column]]:
    return lambda f: {"second": _time(f(0), pattern), **_numbers(*names)(f)}


def _centers(f: Fields) -> dict[str, Column]:
    """The date is the file name's; hours past 23 run on into the next day; v stands before u."""
    day = _time(F.substring(F.element_at(F.split(F.input_file_name(), "/"), -1), 1, 8), "yyyyMMdd")
    clock = [F.substring(f(0), k, 2).cast("long") for k in (1, 3, 5)]
    return {"second": day + clock[0] * 3600 + clock[1] * 60 + clock[2], **_numbers("latitude", "longitude", "v", "u")(f)}


WEIGHTS = [f"weight_{v}_{d}" for v in range(7) for d in range(4)]


def _equations(f: Fields) -> dict[str, Column]:
    """Already made equations; the second column is the inverse error."""
    out = {n: f(k).cast("double") for k, n in enumerate(("value", "inverse_error", "x", "y", "z"))}
    return {**out, "type": f(5).cast("int"), "second": f(6).cast("long"), **{n: f(7 + k).cast("double") for k, n in enumerate(WEIGHTS)}}


def _coefficients(f: Fields) -> dict[str, Column]:
    """An analysis written earlier is the next one's background: the fifth column."""
    return {**{n: f(k).cast("int") for k, n in enumerate(("variable", "i", "j", "k"))}, "background": f(4).cast("double")}


SPACES, COMMAS = r"\s+", r"\s*,\s*"
LAYOUTS = {
    "insitu": Layout(SPACES, _insitu),
    "dawn": Layout(COMMAS, _timed("yyyy-MM-dd'T'HH:mm:ss", "latitude", "longitude", "altitude", "u", "v")),
    "hamsr": Layout(COMMAS, _timed("yyyy-MM-dd'T'HH:mm:ss", "latitude", "longitude", "altitude", "pressure", "temperature", "mixing_ratio")),
    "model": Layout(SPACES, _timed("yyyy-MM-dd_HH:mm:ss", "latitude", "longitude", "altitude", "u", "v", "w", "temperature", "mixing_ratio", "dry_density", "moist_density", "reflectivity")),
    "hgt": Layout(SPACES, _numbers("latitude", "longitude", "altitude", "slope_x", "slope_y", "x", "y", first=0)),
    "cen": Layout(SPACES, _centers),
    "equations": Layout(SPACES, _equations),
    "background": Layout(SPACES, _timed("yyyy-MM-dd_HH:mm:ss", "latitude", "longitude", "altitude", "u", "v", "w", "temperature", "mixing_ratio", "dry_density", "reflectivity", "terrain")),
    "coefficients": Layout(SPACES, _coefficients, skip="Variable"),
    "terrain": Layout(COMMAS, _numbers("x", "y", "height", first=0)),
    "sounding": Layout(SPACES, _numbers("z", "theta", "q", "u", "v", first=0)),
}


def read_text(spark: SparkSession, path: str, kind: str, stream: bool = False) -> DataFrame:
    """The rows of all files of a kind at path, typed."""
    layout = LAYOUTS[kind]
    lines = (spark.readStream if stream else spark.read).text(path)
    lines = lines.where(F.trim("value") != "").withColumn("f", F.split(F.trim("value"), layout.separator))
    if layout.skip:
        lines = lines.where(~F.col("value").contains(layout.skip))
    # [] beyond the end of a line is an error under ANSI rules: a short line fails
    made = layout.columns(lambda k: F.col("f")[k])
    return lines.select(*[c.alias(n) for n, c in made.items()])


def files_by_kind(paths: DataFrame, column: str = "path") -> DataFrame:
    """path and kind, by suffix, in the order of names; files of other suffixes go."""
    kinds = F.create_map(*[F.lit(x) for k in LAYOUTS for x in (k, k)])
    suffix = F.element_at(F.split(column, r"\."), -1)
    return paths.select(F.col(column).alias("path"), F.try_element_at(kinds, suffix).alias("kind")).where("kind IS NOT NULL").orderBy("path")


def with_time_of_first(rows: DataFrame, centers: DataFrame) -> DataFrame:
    """Rows of files that have no time, stamped with the first center's."""
    return rows.crossJoin(F.broadcast(centers.agg(F.min("second").alias("second"))))  # one row


def write_equations(equations: DataFrame, path: str) -> None:
    """Equations as text in the layout that ``read_text(..., "equations")`` reads; NULL as -999."""
    names = ["value", "inverse_error", "x", "y", "z", "type", "second", *WEIGHTS]
    equations.select(F.concat_ws(" ", *[F.coalesce(F.col(n).cast("string"), F.lit("-999")) for n in names]).alias("value")).write.text(path)


def write_fields(fields: DataFrame, path: str) -> None:
    """Gridded fields as tab-separated text with a header; NULL as -999."""
    fields.write.option("sep", "\t").option("header", True).option("nullValue", "-999").csv(path)
