"""Observations, gates, columns and points derived from the driver's tables, in Spark and in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def registered(sql: str | None = None) -> Callable[[Query], Query]:
    def add(query: Query) -> Query:
        QUERIES[query.__name__] = query
        if sql:
            ORACLE_SQL[query.__name__] = sql
        return query

    return add


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rounded(df: DataFrame, *keep: str, places: int = 4) -> DataFrame:
    """keep as they are, all other columns rounded doubles."""
    return df.select(*keep, *[(F.round(F.col(c).cast("double"), places) + 0.0).alias(c) for c in df.columns if c not in keep])


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, k = read(spark, sf_dir, "events"), F.regexp_extract("props", '"k": *([0-9]+)', 1).cast("double")
    i = F.col("event_id")
    out = e.select(
        "event_id", "event_type",
        F.expr("unix_seconds(cast(ts as timestamp))").alias("second"),
        F.when(i % 17 != 0, F.col("value")).alias("speed"),
        ((F.col("user_id") * 37) % 360).cast("double").alias("wdir"),
        (((i * 7919) % 4001) / 100.0 - 20).cast("double").alias("x"),
        (((i * 10477) % 4001) / 100.0 - 20).cast("double").alias("y"),
        ((k * 100) % 15000 + 10.0).alias("z"),
    )
    out = out.withColumn("temperature", 300 - 0.0065 * F.col("z") + (i % 7).cast("double"))
    out = out.withColumn("pressure", 1013.25 * F.exp(-F.col("z") / 8000))
    return out.withColumn("dewpoint", F.when(i % 13 != 0, F.col("temperature") - 1 - (i % 15).cast("double")))


OBS = """raw AS (
    SELECT event_id, event_type, epoch_us(ts) // 1000000 AS second, CASE WHEN event_id % 17 <> 0 THEN value END AS speed,
           CAST((user_id * 37) % 360 AS DOUBLE) AS wdir,
           CAST((event_id * 7919) % 4001 AS DOUBLE) / 100 - 20 AS x, CAST((event_id * 10477) % 4001 AS DOUBLE) / 100 - 20 AS y,
           (CAST(regexp_extract(props, '"k": *([0-9]+)', 1) AS DOUBLE) * 100) % 15000 + 10 AS z
    FROM events
), obs AS (
    SELECT *, 300 - CAST(0.0065 AS DOUBLE) * z + event_id % 7 AS temperature, CAST(1013.25 AS DOUBLE) * exp(-z / 8000) AS pressure,
           CASE WHEN event_id % 13 <> 0 THEN 300 - CAST(0.0065 AS DOUBLE) * z + event_id % 7 - 1 - event_id % 15 END AS dewpoint
    FROM raw
)"""
VAPOR = "6.1078::DOUBLE * exp(17.2694::DOUBLE * (1 - 237.3::DOUBLE / (dewpoint - 273.15::DOUBLE + 237.3::DOUBLE)))"
WIND = "-speed * sin(radians(wdir)) AS u, -speed * cos(radians(wdir)) AS v"


def gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("ray"), F.col("l_linenumber").cast("int").alias("gate"), F.col("l_suppkey").alias("site"),
        F.when(F.col("l_quantity") > 3, F.col("l_quantity")).alias("dbz"), (F.col("l_discount") * 100 - 5).alias("vr"), (F.col("l_tax") * 10).alias("sw"),
        (F.col("l_linenumber") * 150.0 + 1000).alias("distance"), ((F.col("l_orderkey") % 60) * 1.0).alias("elevation"), ((F.col("l_orderkey") * 7 % 360) * 1.0).alias("azimuth"),
    )


GATES = """gates AS (
    SELECT l_orderkey AS ray, CAST(l_linenumber AS INTEGER) AS gate, l_suppkey AS site, CASE WHEN l_quantity > 3 THEN CAST(l_quantity AS DOUBLE) END AS dbz,
           l_discount * 100 - 5 AS vr, l_tax * 10 AS sw, CAST(l_linenumber * 150 + 1000 AS DOUBLE) AS distance,
           CAST(l_orderkey % 60 AS DOUBLE) AS elevation, CAST(l_orderkey * 7 % 360 AS DOUBLE) AS azimuth
    FROM lineitem
)"""


def columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gates with one row for each ray and gate: what ordered work needs."""
    rows = gates(spark, sf_dir)
    return rows.groupBy("ray", "gate").agg(*[F.min(c).alias(c) for c in ("dbz", "vr", "sw", "distance")])


COLUMNS = GATES + """, columns AS (SELECT ray, gate, min(dbz) AS dbz, min(vr) AS vr, min(sw) AS sw, min(distance) AS distance FROM gates GROUP BY ray, gate)"""


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Background samples at scattered places."""
    i = F.col("p_partkey")
    return read(spark, sf_dir, "part").select(
        i.alias("point"), ((i * 7919 % 997) / 50.0).cast("double").alias("x"), ((i * 6007 % 991) / 50.0).cast("double").alias("y"),
        (F.col("p_size") * 1.0).alias("z"), F.col("p_retailprice").alias("value"),
    )


SAMPLES = """samples AS (
    SELECT p_partkey AS point, CAST(p_partkey * 7919 % 997 AS DOUBLE) / 50 AS x, CAST(p_partkey * 6007 % 991 AS DOUBLE) / 50 AS y,
           CAST(p_size AS DOUBLE) AS z, p_retailprice AS value
    FROM part
)"""
