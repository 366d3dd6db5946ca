"""Text sources, the projection and the minimiser."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldspark.functions import projection
from fieldspark.operators import solve
from fieldspark.sources import text


def put(folder, name, *lines):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text("\n".join(lines) + "\n")
    return f"file://{folder}"


def test_insitu_lines(spark, tmp_path):
    where = put(tmp_path / "a", "x.insitu", "2015-10-23T00:00:01 20.5 -105.25 3000 700.5 10.0 -120 270 25.5 -999", "", " 2015-10-23T00:00:02 20.5 -105.25 3000 -999 -150 8 90 10 0.5")
    first, second = text.read_text(spark, where, "insitu").orderBy("second").collect()
    assert first.asDict() == {"second": 1445558401, "latitude": 20.5, "longitude": -105.25, "altitude": 3000.0, "pressure": 700.5, "temperature": 283.15, "dewpoint": None, "direction": 270.0, "speed": 25.5, "w": None}
    assert (second.pressure, second.temperature, second.dewpoint, second.w) == (None, None, 281.15, 0.5)


def test_centers_run_past_midnight(spark, tmp_path):
    where = put(tmp_path / "c", "20151023.cen", "235959 20.0 -105.0 3.5 -1.5", "240001 20.1 -105.1 3.5 -1.5")
    a, b = text.read_text(spark, where, "cen").orderBy("second").collect()
    assert (b.second - a.second, a.v, a.u) == (2, 3.5, -1.5)
    assert a.second == 1445558400 + 86399


def test_other_layouts(spark, tmp_path):
    dawn = text.read_text(spark, put(tmp_path / "d", "x.dawn", "2015-10-23T00:00:01,20, -105,500,3.5,-2"), "dawn").first()
    assert (dawn.altitude, dawn.u, dawn.v) == (500.0, 3.5, -2.0)
    hgt = text.read_text(spark, put(tmp_path / "h", "x.hgt", "20 -105 120 0.1 -0.2 3 4"), "hgt")
    centers = text.read_text(spark, put(tmp_path / "hc", "20151023.cen", "000005 20.0 -105.0 3.5 -1.5"), "cen")
    assert text.with_time_of_first(hgt, centers).first().second == 1445558405


def test_a_short_line_fails(spark, tmp_path):
    with pytest.raises(Exception, match="INVALID_ARRAY_INDEX"):
        text.read_text(spark, put(tmp_path / "s", "x.dawn", "2015-10-23T00:00:01,20"), "dawn").collect()


def test_equations_come_back_as_written(spark, tmp_path):
    rows = spark.range(20).select(F.rand(1).alias("value"), F.lit(0.5).alias("inverse_error"), *[F.rand(k).alias(c) for k, c in enumerate("xyz")], F.lit(3).alias("type"), (F.col("id") + 1445558400).alias("second"), *[F.rand(k).alias(w) for k, w in enumerate(text.WEIGHTS)])
    text.write_equations(rows, f"file://{tmp_path}/e")
    assert sorted(map(tuple, text.read_text(spark, f"file://{tmp_path}/e", "equations").collect())) == sorted(map(tuple, rows.collect()))


def test_files_by_kind(spark):
    paths = spark.createDataFrame([("b/2.dawn",), ("b/1.insitu",), ("b/readme.md",)], "path string")
    assert [tuple(r) for r in text.files_by_kind(paths).collect()] == [("b/1.insitu", "insitu"), ("b/2.dawn", "dawn")]


def test_a_folder_followed_as_a_stream(spark, tmp_path):
    where = put(tmp_path / "w", "1.dawn", "2015-10-23T00:00:01,20,-105,500,3.5,-2")
    query = text.read_text(spark, where, "dawn", stream=True).writeStream.format("memory").queryName("followed").trigger(availableNow=True).option("checkpointLocation", f"file://{tmp_path}/at").start()
    query.awaitTermination(60)
    assert spark.table("followed").count() == 1


def test_projection(spark):
    rows = spark.sql("SELECT CAST(a AS DOUBLE) AS lat, CAST(b AS DOUBLE) AS lon FROM VALUES (0, 0), (0, 3), (45, 0), (80, -4), (-33, 5), (89, 2) t(a, b)")
    x, y = projection.forward(F.col("lat"), F.col("lon"))
    rows = rows.select("lat", "lon", x.alias("x"), y.alias("y"))
    lat, lon = projection.reverse(F.col("x"), F.col("y"))
    for r in rows.select("*", lat.alias("lat2"), lon.alias("lon2")).collect():
        assert abs(r.lat - r.lat2) < 1e-9 and abs(r.lon - r.lon2) < 1e-9
        if r.lon == 0:  # on the central meridian y is the length of its arc
            f, a = projection.FLATTENING, projection.RADIUS
            e2 = f * (2 - f)
            t = np.linspace(0, math.radians(r.lat), 20_001)
            arc = np.trapezoid(a * (1 - e2) / (1 - e2 * np.sin(t) ** 2) ** 1.5, t)
            assert abs(r.y - projection.SCALE * arc) < 1e-3 and abs(r.x) < 1e-9


def test_minimiser_against_a_direct_solution(spark):
    rng = np.random.default_rng(2)
    m, n = 60, 25
    dense = np.where(rng.random((m, n)) < 0.2, rng.standard_normal((m, n)), 0.0)
    value, weight = rng.standard_normal(m), rng.random(m) + 0.1
    h = spark.createDataFrame([(int(i), int(j), float(dense[i, j])) for i, j in zip(*np.nonzero(dense), strict=True)], "row long, col long, h double")
    d = spark.createDataFrame([(i, float(value[i]), float(weight[i])) for i in range(m)], "row long, d double, weight double")
    want = np.linalg.solve(np.eye(n) + dense.T @ (weight[:, None] * dense), dense.T @ (weight * value))
    found = solve.conjugate_gradient(h, d, 40, 1e-8)
    got = {r.col: r.x for r in found.collect()}
    assert max(abs(got.get(j, 0.0) - want[j]) for j in range(n)) < 1e-6
    best = 0.5 * (want @ want + (weight * (dense @ want - value) ** 2).sum())
    assert abs(solve.cost(h, d, found) - best) < 1e-6


def test_minimiser_query_is_the_dense_solution(spark):
    from fieldspark import catalog

    at = "/root/testdata/sf0.001"
    lines = spark.read.parquet(f"{at}/lineitem.parquet").select("l_orderkey", "l_partkey", F.col("l_quantity").cast("double")).collect()
    orders = {r[0]: float(r[1]) / 100_000 for r in spark.read.parquet(f"{at}/orders.parquet").select("o_orderkey", F.col("o_totalprice").cast("double")).collect()}
    row, col = ({k: i for i, k in enumerate(sorted(keys))} for keys in (orders, {r[1] for r in lines}))
    dense = np.zeros((len(row), len(col)))
    for order, part, quantity in lines:
        if order in row:
            dense[row[order], col[part]] += quantity / 50
    want = np.linalg.solve(np.eye(len(col)) + 0.2 * dense.T @ dense, 0.2 * dense.T @ np.array([orders[k] for k in sorted(orders)]))
    got = {r.col: r.x for r in catalog.QUERIES["sol11_conjugate_gradient"](spark, at).collect()}
    assert max(abs(float(got.get(k, 0.0)) - want[i]) for k, i in col.items()) < 6e-5


def test_followed_files_are_counted_by_hour(spark, tmp_path):
    from fieldspark import streaming

    folder = tmp_path / "arriving"
    folder.mkdir()
    lines = [f"2024-01-05T{h:02d}:{m:02d}:00 20.0 -60.0 1000 900.0 10.0 5.0 90 10 0.5" for h, m in [(1, 5), (1, 50), (2, 10), (4, 0), (6, 30)]]
    (folder / "a.insitu").write_text("\n".join(lines))
    counts = streaming.counted(streaming.followed(spark, f"file://{folder}", "insitu"))
    query = counts.writeStream.format("memory").queryName("followed_counts").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination()
    assert sorted(r.n_rows for r in spark.table("followed_counts").collect()) == [1, 1, 1, 2]


def test_beams_that_point_along_and_up(spark):
    """A level aircraft that flies north: the beam ahead, to the side and up."""
    from fieldspark.functions import radar

    rows = spark.createDataFrame([(0.0, 90.0), (90.0, 0.0), (0.0, 0.0)], "rotation double, tilt double")
    zero = F.lit(0.0)
    azimuth, elevation = radar.earth_angles(zero, zero, zero, zero, F.col("rotation"), F.col("tilt"))
    found = [(round(r.a, 6) % 360, round(r.e, 6)) for r in rows.select(azimuth.alias("a"), elevation.alias("e")).collect()]
    assert found[0] == (0.0, 0.0) and found[1] == (90.0, 0.0) and found[2][1] == 90.0


def test_splines_sum_to_one_and_their_slopes_to_zero(spark):
    from fieldspark.functions import spline

    rows = spark.range(101).select((F.col("id") / 100).alias("t"))
    sums = [sum(spline.basis(F.col("t") - k, d) for k in (-1, 0, 1, 2)).alias(f"d{d}") for d in (0, 1)]
    assert all(abs(r.d0 - 1) < 1e-12 and abs(r.d1) < 1e-12 for r in rows.select(*sums).collect())
