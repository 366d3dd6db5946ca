"""netCDF-3: files made byte by byte here are read, and what is written is read back."""

from __future__ import annotations

import os
import struct

import numpy as np
import pytest

from fieldspark.sources import netcdf, netcdf_observations


def made(path, dims, variables, attributes=None, records=0):
    """A file by the published layout; variables: name -> (dims, array, attributes); the first dimension of size 0 grows."""
    head = netcdf.Header(dims, attributes or {}, {k: netcdf.Variable(list(d), np.asarray(a).dtype.newbyteorder(">").str if np.asarray(a).dtype.kind != "S" else "S1", at) for k, (d, a, at) in variables.items()}, records)
    raw = netcdf.planned(head)
    with open(path, "wb") as f:
        f.write(raw)
        for k, (_, a, _at) in variables.items():
            v, data = head.variables[k], np.ascontiguousarray(np.asarray(a).astype(np.asarray(a).dtype.newbyteorder(">")))
            if head.grows(v):
                for i in range(len(data)):
                    f.seek(v.begin + i * head.record_bytes)
                    f.write(data[i : i + 1].tobytes())
            else:
                f.seek(v.begin)
                f.write(data.tobytes())
        f.seek(0, 2)
        f.write(b"\0" * 8)


def test_header_is_the_published_one(tmp_path):
    """Bytes put together by hand: one dimension of two, one integer variable with an attribute."""
    raw = b"CDF\x01" + struct.pack(">i", 0) + struct.pack(">iii", 10, 1, 1) + b"x\0\0\0" + struct.pack(">i", 2) + struct.pack(">ii", 0, 0)
    raw += struct.pack(">iii", 11, 1, 1) + b"v\0\0\0" + struct.pack(">ii", 1, 0) + struct.pack(">iii", 12, 1, 5) + b"units\0\0\0" + struct.pack(">ii", 2, 1) + b"m\0\0\0"
    raw += struct.pack(">iii", 4, 8, len(raw) + 12) + struct.pack(">ii", 7, -3)
    (tmp_path / "a.nc").write_bytes(raw)
    h = netcdf.header_of(str(tmp_path / "a.nc"))
    assert h.dims == {"x": 2} and h.variables["v"].attributes == {"units": "m"} and h.variables["v"].begin == len(raw) - 8


def test_one_file_is_read_by_many_tasks_and_only_what_is_asked(spark, tmp_path):
    n = 1000
    made(tmp_path / "r.nc", {"t": 0, "level": 3}, {"time": (["t"], np.arange(n, dtype="f8"), {}), "temp": (["t", "level"], np.arange(3 * n, dtype="i2").reshape(n, 3), {"scale_factor": 0.5, "add_offset": 1.0, "_FillValue": 4}), "level": (["level"], np.array([1, 2, 3], "f4"), {}), "other": (["t"], np.zeros(n, "f8"), {}), "odd": (["t"], np.zeros(n, "i1"), {})}, records=n)
    df = netcdf.read_netcdf(spark, f"file://{tmp_path}/r.nc", "time double, level double, temp double", rowsPerTask=300)
    assert df.rdd.getNumPartitions() == 10
    assert "other" not in df._jdf.queryExecution().executedPlan().toString()
    rows = df.orderBy("time", "level").collect()
    assert [(r.time, r.level, r.temp) for r in rows] == [(float(i), float(k + 1), None if 3 * i + k == 4 else (3 * i + k) * 0.5 + 1) for i in range(n) for k in range(3)]
    assert netcdf.read_netcdf(spark, str(tmp_path), "other double").count() == n
    odd = netcdf.read_netcdf(spark, str(tmp_path), "time double, nothing double, t int").orderBy("time").collect()
    assert odd[5].nothing is None and odd[5].t == 5


def test_grid_round_trip(spark, tmp_path):
    axes = {"altitude": [0.0, 500.0, 1000.0], "latitude": [10.0, 10.5], "longitude": [-60.0, -59.0, -58.0, -57.0]}
    rows = [(k, j, i, None if k == j == i == 1 else float(100 * k + 10 * j + i), -1.5 * i) for k in range(3) for j in range(2) for i in range(4)]
    grid = spark.createDataFrame(rows, "ialtitude int, ilatitude int, ilongitude int, U double, V double").repartition(7)
    path = f"file://{tmp_path}/out/analysis.nc"
    netcdf.write_netcdf(grid, path, axes, ["U", "V"], {"U": {"units": "m s-1", "long_name": "eastward"}, "altitude": {"units": "m"}}, {"Conventions": "CF-1.0", "dx": 0.5})
    assert os.listdir(tmp_path / "out") == ["analysis.nc"]
    h = netcdf.header_of(path)
    assert h.attributes == {"Conventions": "CF-1.0", "dx": 0.5} and h.variables["U"].attributes["units"] == "m s-1" and h.variables["U"].dims == list(axes)
    back = netcdf.read_netcdf(spark, path, "altitude double, latitude double, longitude double, U double, V double", rowsPerTask=4)
    assert back.rdd.getNumPartitions() == 3
    got = {(r.altitude, r.latitude, r.longitude): (r.U, r.V) for r in back.collect()}
    assert got == {(axes["altitude"][k], axes["latitude"][j], axes["longitude"][i]): (u, v) for k, j, i, u, v in rows}


def test_a_failed_write_leaves_no_file(spark, tmp_path):
    from pyspark.sql import functions as F

    axes = {"z": [0.0, 1.0], "x": [0.0, 1.0, 2.0]}
    grid = spark.createDataFrame([(k, i, 1.0) for k in range(2) for i in range(3)], "iz int, ix int, U double")
    broken = grid.withColumn("U", F.when((F.col("iz") == 1) & (F.col("ix") == 2), F.raise_error(F.lit("no")).cast("double")).otherwise(F.col("U")))
    for bad in (broken, grid.where("NOT (iz = 1 AND ix = 2)")):
        with pytest.raises(Exception):
            netcdf.write_netcdf(bad, f"{tmp_path}/f.nc", axes, ["U"])
        assert os.listdir(tmp_path) == []


def test_observation_kinds(spark, tmp_path):
    n = 4
    one = {k: (["recNum"], np.full(n, v, "f8"), {}) for k, v in {"latitude": 20, "longitude": -60, "elevation": 12, "observationTime": 1e9, "temperature": 290, "dewpoint": 1e35, "windDir": 90, "windSpeed": -9999, "stationPressure": 100_000}.items()}
    os.makedirs(tmp_path / "m")
    made(tmp_path / "m" / "a.nc", {"recNum": 0}, one, records=n)
    r = netcdf_observations.read_observations(spark, str(tmp_path / "m"), "mesonet").first()
    assert (r.second, r.pressure, r.dewpoint, r.speed, r.direction) == (10**9, 1000.0, None, None, 90.0)
    sonde = {k: (["time"], np.full(n, v, "f4"), {}) for k, v in {"lat": 20, "lon": -60, "alt": 1.5, "temp": 10, "rh": 100, "wdir": 90, "wspd": 5, "pres": 900}.items()} | {"time": (["time"], np.arange(n, dtype="f8"), {})}
    os.makedirs(tmp_path / "s")
    made(tmp_path / "s" / "site_20200102_0304.nc", {"time": n}, sonde)
    rows = netcdf_observations.read_observations(spark, str(tmp_path / "s"), "classnc").orderBy("second").collect()
    assert rows[1].second == 1577934241 and rows[0].altitude == 1500.0 and abs(rows[0].dewpoint - 283.15) < 0.2
    level = {"height": (["pres_level"], np.array([0, 100], "f4"), {}), "base_time": ([], np.array(1000, "i4"), {}), "time_offset": (["time"], np.array([1, 2, 3], "f8"), {}), "lat": ([], np.array(20, "f4"), {}), "lon": ([], np.array(-60, "f4"), {}), "alt": ([], np.array(10, "f4"), {}), **{k: (["time", "pres_level"], np.arange(6, dtype="f4").reshape(3, 2), {}) for k in ("ambientTemp", "dewpointTemp", "pressure")}}
    os.makedirs(tmp_path / "p")
    made(tmp_path / "p" / "a.nc", {"time": 0, "pres_level": 2}, level, records=3)
    rows = netcdf_observations.read_observations(spark, str(tmp_path / "p"), "aeri", rowsPerTask=2).orderBy("second", "altitude").collect()
    assert [(r.second, r.altitude, r.temperature) for r in rows] == [(1001, 10.0, 0.0), (1001, 110.0, 1.0), (1002, 10.0, 2.0), (1002, 110.0, 3.0), (1003, 10.0, 4.0), (1003, 110.0, 5.0)]
    wind = np.array([1, np.nan], "f4").reshape(1, 1, 1, 2)
    os.makedirs(tmp_path / "g")
    made(tmp_path / "g" / "a.nc", {"time": 1, "z0": 1, "y0": 1, "x0": 2}, {k: (["time", "z0", "y0", "x0"], wind, {}) for k in ("U", "V", "W", "DBZ", "U_std", "V_std", "W_std")} | {"x0": (["x0"], np.array([5, 6], "f4"), {})}, {"sam_i_incr": 0.5})
    rows = netcdf_observations.read_observations(spark, str(tmp_path / "g"), "fractl").orderBy("x").collect()
    assert [(r.x, r.u, r.reflectivity) for r in rows] == [(5.0, 1.0, 1.0), (6.0, 0.0, -35.0)]
    errors = netcdf_observations.read_observations(spark, str(tmp_path / "g"), "fractl_errors").orderBy("x").collect()
    assert [r.u for r in errors] == [1.0, None]
    assert netcdf_observations.grid_of(str(tmp_path / "g" / "a.nc"))["sam_i_incr"] == 0.5


def test_a_long_file_is_read_by_a_bounded_number_of_tasks(spark, tmp_path):
    """Small pieces are read one behind the other: a file's tasks do not grow with it without end."""
    rows = spark.range(5000).selectExpr("id AS itime", "id * 0.5D AS v")
    netcdf.write_netcdf(rows, f"{tmp_path}/long.nc", {"time": 5000}, ["v"], doubles=True)
    found = netcdf.read_netcdf(spark, f"{tmp_path}/long.nc", "time long, v double", rowsPerTask=3)
    assert found.rdd.getNumPartitions() <= netcdf.TASKS
    assert sorted((r.time, r.v) for r in found.collect()) == [(k, k / 2) for k in range(5000)]
