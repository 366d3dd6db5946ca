"""Files of lines under a header, cut into blocks of any size."""

from __future__ import annotations

import numpy as np
import pytest

from fieldspark.sources import flights, lines


@pytest.fixture(params=[64, 1000, 1 << 27])
def block(spark, request):
    """The largest block in bytes: one that cuts headers and radials, one that cuts files, one that cuts nothing."""
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(request.param))
    yield request.param
    spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_numbers_do_not_depend_on_blocks(spark, tmp_path, block):
    rng = np.random.default_rng(3)
    wanted = []
    for name in "abc":
        told = ["x" * int(n) for n in rng.integers(0, 90, 70)]
        (tmp_path / name).write_text("\n".join(told) + ("\n" if name != "b" else ""))
        if name == "b" and told[-1] == "":
            told.pop()
        wanted += [(name, k, t) for k, t in enumerate(told)]
    found = lines.numbered(spark, f"file://{tmp_path}")
    assert found.rdd.getNumPartitions() >= 1
    assert sorted((r.file[-1], r.number, r.value) for r in found.collect()) == sorted(wanted)


def test_radials_across_blocks(spark, tmp_path, block):
    wanted = []
    for n, gates in enumerate((10, 23, 7)):
        told = ["20200101", "42RF", "01", str(gates), "1000", "150", "0", "0"]
        for ray in range(40):
            told.append(f"{1577836800 + ray}.0 20.5 -60.25 3000 {ray} {n}")
            values = [-8888 if (g + ray) % 5 == 0 else g * 10 + ray for g in range(gates)]
            told += [" ".join(map(str, values[a : a + 10])) for a in range(0, gates, 10)]
            wanted += [(1577836800 + ray, 90.0 - ray, float(n), 1000 + 150.0 * (g + 1), v / 10) for g, v in enumerate(values) if v != -8888]
        (tmp_path / f"{n}.list").write_text("\n".join(told) + "\n")
    found = flights.read_radials(spark, f"file://{tmp_path}")
    assert sorted((r.second, r.azimuth, r.elevation, r.distance, r.velocity) for r in found.collect()) == sorted(wanted)
    assert {(r.reflectivity, r.latitude, r.altitude) for r in found.collect()} == {(10.0, 20.5, 3000.0)}


def test_headers_reach_lines_of_other_blocks(spark, tmp_path, block):
    data = [f"{h:02d}0001 2000N 06030W 0050 03000 //// +100 //// 270020 050 /// 000 00" for h in range(20)]
    for day in (1, 2):
        (tmp_path / f"{day}.hdob").write_text("\r\n".join([f"AF300 01HHA STORM HDOB 01 2020010{day}", *data, "$$", "", "remarks that are no data"]) + "\r\n")
    found = flights.read_flights(spark, f"file://{tmp_path}", "hdob").collect()
    assert sorted(r.second for r in found) == [1577836800 + 86400 * d + 3600 * h + 1 for d in (0, 1) for h in range(20)]
    assert {(r.latitude, r.longitude, r.pressure, r.dewpoint) for r in found} == {(20.0, -60.5, 1005.0, None)}


def test_a_sounding_without_a_line_of_dashes_has_no_data(spark, tmp_path, block):
    (tmp_path / "x.eol").write_text("UTC Launch Time (y,m,d,h,m,s):             2020, 01, 01, 00:00:00\n1 2 3\n")
    assert flights.read_flights(spark, f"file://{tmp_path}", "eol").count() == 0


def test_radials_are_written_by_more_tasks_as_rays_grow(spark, tmp_path, monkeypatch):
    """Files hold a bounded number of rays, whatever the table."""
    from fieldspark.plans import files

    lineitem = spark.range(200_000).selectExpr("id AS l_orderkey", "1 AS l_linenumber", "1L AS l_suppkey", "5.0D AS l_quantity", "0.05D AS l_discount", "0.01D AS l_tax")
    lineitem.write.parquet(str(tmp_path / "lineitem.parquet"))
    seen = []
    monkeypatch.setattr(files.flights, "write_flights", lambda lines, path: seen.append(lines.groupBy("name").count().collect()))
    monkeypatch.setattr(files.flights, "read_radials", lambda spark, path: spark.range(1).withColumnRenamed("id", "second"))
    files.src26_radials(spark, str(tmp_path))
    assert len(seen[0]) == 13 and max(r["count"] for r in seen[0]) == 16384 * 4 + 8
