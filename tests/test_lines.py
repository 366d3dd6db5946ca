"""Recurrences along lines against plain loops and dense matrices, by any cut into blocks."""

from __future__ import annotations

import numpy as np
import pytest

from fieldspark.operators import lines


def slow_filter(v, scale):
    c = lines.filter_coefficients(scale)
    q = np.zeros(len(v))
    for m in range(len(v)):
        q[m] = c.gain * v[m] + sum(w * q[m - k] for k, w in enumerate(c.weights, 1) if m >= k)
    s = np.zeros(len(v))
    s[-4:] = c.ends @ q[-4:]
    for m in range(len(v) - 5, -1, -1):
        s[m] = c.gain * q[m] + sum(w * s[m + k] for k, w in enumerate(c.weights, 1))
    return s


def told(df, n, value="v"):
    out = {}
    for r in df.collect():
        out.setdefault(r.line, np.full(n, np.nan))[r.at] = r[value]
    return out


def table(spark, made):
    return spark.createDataFrame([(k, i, float(x)) for k, v in made.items() for i, x in enumerate(v)], "line int, at int, v double").repartition(5)


@pytest.mark.parametrize("n, block", [(4, 4096), (5, 2), (37, 4096), (37, 8), (100, 7), (103, 10), (64, 16)])
def test_filter_by_blocks(spark, n, block):
    rng = np.random.default_rng(n)
    made = {k: rng.normal(size=n) for k in range(5)}
    got = told(lines.recursive_filter(table(spark, made), ["line"], "at", "v", 2.2, n, block), n)
    assert all(np.allclose(got[k], slow_filter(made[k], 2.2), atol=1e-12) for k in made)


def test_filter_is_symmetric_and_close_to_a_gaussian():
    n, scale = 81, 4.0
    whole = np.stack([slow_filter(row, scale) for row in np.eye(n)])
    assert np.allclose(whole, whole.T, atol=1e-12)
    bell = np.exp(-((np.arange(n) - 40) ** 2) / (2 * scale**2)) / np.sqrt(2 * np.pi) / scale
    assert np.abs(whole[40] - bell).max() < 0.03 * bell.max()  # fourth order: 2 % at the peak
    assert abs(whole[40].sum() - 1) < 1e-6
    # its transform is one over the expansion of exp(scale^2 k^2 / 2) to the eighth power of k
    k = np.array([0.02, 0.05, 0.1, 0.2])
    seen = [(whole[40] * np.cos(x * (np.arange(n) - 40))).sum() for x in k]
    assert np.allclose(1 / np.array(seen), sum((scale**2 * k**2 / 2) ** m / np.prod(np.arange(1, m + 1)) for m in range(5)), rtol=1e-4)


def test_filter_leaves_short_lines_and_fails_on_gaps(spark):
    short = table(spark, {1: [1.0, 2.0, 3.0]})
    assert told(lines.recursive_filter(short, ["line"], "at", "v", 2.0, 3), 3)[1].tolist() == [1, 2, 3]
    gap = spark.createDataFrame([(1, i, 1.0) for i in (0, 1, 2, 3, 5)], "line int, at int, v double")
    with pytest.raises(Exception, match="missing or a repeated place"):
        lines.recursive_filter(gap, ["line"], "at", "v", 2.0, 5).collect()


def test_a_long_line_is_no_single_task(spark):
    """The scan of a line takes its blocks' sums, four numbers each."""
    n = 5000
    line = spark.range(n).selectExpr("0 AS line", "CAST(id AS INT) AS at", "sin(id) AS v")
    got = told(lines.recursive_filter(line, ["line"], "at", "v", 3.0, n, block=64), n)[0]
    assert np.allclose(got, slow_filter(np.sin(np.arange(n)), 3.0), atol=1e-11)


ENDS = [("R0", "R0"), ("R1T0", "R1T1"), ("R1T2", "R2T10"), ("R2T20", "R3"), ("R3", "R1T0"), ("R2T10", "R2T20"), ("PERIODIC", "PERIODIC")]


@pytest.mark.parametrize("left, right", ENDS)
@pytest.mark.parametrize("block", [4096, 8])
def test_spline_against_a_dense_solve(spark, left, right, block):
    n = 30
    if block < n and left == "PERIODIC":
        with pytest.raises(ValueError):
            lines.spline_transform(table(spark, {0: np.ones(n)}), ["line"], "at", "v", lines.SplineSystem.of(n, 0.5, 3.0, left, right), block)
        return
    system = lines.SplineSystem.of(n, 0.5, 3.0, left, right)
    g = lines.folding(n, left, right)
    whole = g.T @ np.linalg.solve(g @ lines.spline_matrix(n, 0.5, 3.0, left, right) @ g.T, g)
    rng = np.random.default_rng(3)
    made = {k: rng.normal(size=n) for k in range(3)}
    got = told(lines.spline_transform(table(spark, made), ["line"], "at", "v", system, block), n)
    assert all(np.allclose(got[k], whole @ made[k], rtol=1e-8, atol=1e-10) for k in made)


def value_at(a, x, derivative=0):
    """The spline of coefficients a at x, in nodes."""
    z = x - np.arange(len(a))
    s, t = np.abs(z), np.where(z > 0, -1.0, 1.0)
    b = {0: np.clip(2 - s, 0, None) ** 3 / 6 - np.clip(1 - s, 0, None) ** 3 * 4 / 6, 1: (np.clip(2 - s, 0, None) ** 2 / 2 - np.clip(1 - s, 0, None) ** 2 * 2) * t, 2: np.clip(2 - s, 0, None) - 4 * np.clip(1 - s, 0, None)}[derivative]
    return float(b @ a)


@pytest.mark.parametrize("kind, zero", [("R1T0", [0]), ("R1T1", [1]), ("R1T2", [2]), ("R2T10", [0, 1]), ("R2T20", [0, 2]), ("R3", [0, 1, 2])])
def test_conditions_hold(kind, zero):
    """Value, slope or bend that a condition sets are zero at the first inner node and at the last."""
    n = 25
    a = lines.SplineSystem.of(n, 1.0, 2.0, kind, kind).dense() @ np.random.default_rng(5).normal(size=n)
    for d in zero:
        assert abs(value_at(a, 1.0, d)) < 1e-9 and abs(value_at(a, n - 2.0, d)) < 1e-9


def test_periodic_lines_meet():
    n = 25
    a = lines.SplineSystem.of(n, 1.0, 2.0, "PERIODIC", "PERIODIC").dense() @ np.random.default_rng(6).normal(size=n)
    assert all(abs(value_at(a, 1.0, d) - value_at(a, n - 2.0, d)) < 1e-9 for d in (0, 1, 2))
