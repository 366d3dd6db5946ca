"""Sweep files: either byte order, plain and coded words, ranges of bytes, airborne angles, broken files."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given
from hypothesis import strategies as st

from fieldspark.operators import runs
from fieldspark.sources import dorade

GATES = [-50.0, 100.0, 250.0, 400.0, 550.0, 700.0]
START = 1577836800  # 2020-01-01


def made(n: int = 50, **options):
    rng = np.random.default_rng(5)
    told = [{"second": START + 86400 * 40 + 3000 * k, "azimuth": k * 7.0, "elevation": k / 2, "latitude": 20.5, "longitude": -60.25, "altitude": 3.0} for k in range(n)]
    fields = {f: [np.where(rng.random(6) < 0.4, np.nan, rng.integers(-3000, 3000, 6) / 100) for _ in range(n)] for f in ("DZ", "VE", "SW", "NCP")}
    return told, fields, dorade.sweep_bytes(GATES, told, fields, **options)


def plain(row) -> tuple:
    return tuple(None if x is None else round(x, 6) for x in row)


@pytest.mark.parametrize("order", ["<", ">"])
@pytest.mark.parametrize("compressed", [True, False])
@pytest.mark.parametrize("task", [300, 5000, 1 << 26])
def test_read_back(spark, tmp_path, order, compressed, task):
    told, fields, raw = made(order=order, compressed=compressed, radar_told={"wide": 1.5, "high": 2.5, "scan_mode": 1}, correction={"latitude": 0.25, "altitude": 0.5})
    (tmp_path / "swp.1").write_bytes(raw)
    (tmp_path / ".hidden").write_bytes(b"no sweep")
    found = dorade.read_dorade(spark, f"file://{tmp_path}", "DZ", "VE", "SW", bytesPerTask=task)
    assert found.rdd.getNumPartitions() == -(-len(raw) // task)
    rows = [plain((r.ray, r.gate, r.second, r.azimuth, r.elevation, r.distance, r.latitude, r.altitude, r.beam_width, r.reflectivity, r.velocity, r.width)) for r in found.collect()]
    wanted = [
        plain((k, g + 1, t["second"], t["azimuth"], t["elevation"], GATES[g], 20.75, 3500.0, 2.0, *[None if np.isnan(fields[f][k][g]) else fields[f][k][g] for f in ("DZ", "VE", "SW")]))
        for k, t in enumerate(told) for g in range(6)
    ]
    assert sorted(rows, key=lambda r: r[:2]) == wanted


def test_only_asked_fields_are_decoded(spark, tmp_path, monkeypatch):
    _, _, raw = made(3)
    seen = []
    monkeypatch.setattr(dorade, "_gates", lambda s, name, raw: seen.append(name) or np.zeros(len(s.gates)))
    f = pa.BufferReader(raw)
    list(dorade.rays(f, len(raw), {"VE"}))
    assert seen == ["VE"] * 3


def test_a_field_that_a_file_lacks_is_null(spark, tmp_path):
    (tmp_path / "swp.1").write_bytes(made(2)[2])
    found = dorade.read_dorade(spark, f"file://{tmp_path}", "DZ", "none", "SW").collect()
    assert len(found) == 12 and {r.velocity for r in found} == {None} and {r.reflectivity for r in found} != {None}


def test_airborne_angles(spark, tmp_path):
    """Level flight to the north: the beam to the right points east, the one up points up; a correction of the heading turns it."""
    level = {"second": START, "azimuth": 1.0, "elevation": 1.0, "latitude": 20.0, "longitude": -60.0, "altitude": 3.0, "heading": 0.0, "roll": 0.0, "pitch": 0.0, "drift": 0.0, "tilt": 0.0}
    told = [level | {"rotation": 90.0}, level | {"rotation": 0.0}, level | {"rotation": 90.0, "roll": -30.0}]
    raw = dorade.sweep_bytes([100.0], told, {"VE": [np.ones(1)] * 3}, radar_told={"scan_mode": dorade.AIRBORNE}, correction={"heading": 10.0})
    (tmp_path / "swp.1").write_bytes(raw)
    side, up, banked = dorade.read_dorade(spark, f"file://{tmp_path}", velocity="VE").orderBy("ray").collect()
    assert (side.azimuth, side.elevation) == (pytest.approx(100), pytest.approx(0, abs=1e-9))
    assert up.elevation == pytest.approx(90)
    assert (banked.azimuth, banked.elevation) == (pytest.approx(100), pytest.approx(30))


def test_broken_files_fail(spark, tmp_path):
    raw = made(4)[2]
    for name, bad in (("cut", raw[: len(raw) // 2 + 1]), ("text", b"no sweep file at all"), ("zero", raw[:200] + b"\0" * 200)):
        folder = tmp_path / name
        folder.mkdir()
        (folder / "swp").write_bytes(bad)
        with pytest.raises(Exception, match="sweep|block"):
            dorade.read_dorade(spark, f"file://{folder}").collect()


@given(st.lists(st.one_of(st.just(-999), st.integers(-32768, 32767)), max_size=60))
def test_words_come_back(values):
    v = np.array(values, np.int16)
    assert runs.decode(runs.encode(v, -999), -999).tolist() == values


@given(st.integers(0, 9).flatmap(lambda n: st.lists(st.lists(st.one_of(st.just(-999), st.integers(-32768, 32767)), min_size=n, max_size=n), min_size=1, max_size=5)))
def test_rows_are_coded_as_each_alone(rows):
    v = np.array(rows, np.int16).reshape(len(rows), -1)
    words, many = runs.encode_rows(v, -999)
    assert words.tolist() == [w for row in v for w in runs.encode(row, -999).tolist()]
    ends = np.cumsum(many)
    assert runs.decode_rows(words, ends - many, ends, v.shape[1], -999).tolist() == v.tolist()


@pytest.mark.parametrize("compressed", [True, False])
def test_batches_of_rays_say_what_each_ray_says(compressed):
    """The same rays and values as read one by one; and decoding is by the batch, not a call a ray."""
    _, _, raw = made(compressed=compressed)
    one = list(dorade.rays(pa.BufferReader(raw), len(raw), {"DZ", "NCP"}, 2000, 6000))
    held = list(dorade.ray_batches(pa.BufferReader(raw), len(raw), {"DZ", "NCP"}, 2000, 6000))
    assert len(held) == 1 and held[0].numbers == [r.number for _, r in one] and held[0].values("VE").shape == (len(one), 6)
    for f in ("DZ", "NCP"):
        assert np.array_equal(held[0].values(f), np.array([r.values[f] for _, r in one]), equal_nan=True)
    assert held[0].told()["azimuth"].tolist() == [r.told["azimuth"] for _, r in one]


def test_small_files_share_a_task(spark, tmp_path):
    raw = made(2)[2]
    for k in range(40):
        (tmp_path / f"swp.{k}").write_bytes(raw)
    found = dorade.read_dorade(spark, f"file://{tmp_path}", "DZ", "VE", "SW", bytesPerTask=80 * len(raw))
    assert found.rdd.getNumPartitions() == 4 and found.count() == 40 * 12
