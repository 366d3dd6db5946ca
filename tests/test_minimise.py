"""Minimisers on tables against numpy on the same small problems."""

from __future__ import annotations

import numpy as np
import pytest

from fieldspark.operators import minimise, solve
from fieldspark.operators.minimise import CAUCHY, SQUARE


def problem(spark, rows=12, cols=4, seed=2, far=0.0):
    rng = np.random.default_rng(seed)
    h = np.where(rng.random((rows, cols)) < 0.6, rng.normal(size=(rows, cols)), 0.0)
    h[0] = 1.0  # every column has an entry
    d, w = rng.normal(size=rows) * 3 + far, rng.random(rows) + 0.5
    table = spark.createDataFrame([(i, j, float(h[i, j])) for i in range(rows) for j in range(cols) if h[i, j]], "row int, col int, h double")
    return h, d, w, table, spark.createDataFrame([(i, float(d[i]), float(w[i])) for i in range(rows)], "row int, d double, weight double")


def state(point, n):
    out = np.zeros(n)
    for r in point.state.collect():
        out[r.col] = r.x
    return out


def gradient(h, d, w, x, loss):
    r = h @ x - d
    return x + h.T @ (w * (r if loss is SQUARE else r / (1 + r * r)))


def test_truncated_newton_finds_the_direct_minimum(spark):
    h, d, w, table, told = problem(spark)
    direct = np.linalg.solve(np.eye(4) + h.T @ (w[:, None] * h), h.T @ (w * d))
    with solve.SparseOperator(table, 4) as op:
        found = minimise.truncated_newton(minimise.Cost(op, told), tolerance=1e-6)
        assert np.allclose(state(found.point, 4), direct, atol=1e-4) and found.bends == 0
        plan = op.product(found.point.state.select("col", "x"), "x")._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning(col") <= 1  # H does not move


def test_negative_curvature_ends_the_inner_loop(spark):
    """Residuals far from zero: the cost bends down at the start, and the exit is taken."""
    h, d, w, table, told = problem(spark, far=6.0)
    assert np.linalg.eigvalsh(np.eye(4) + h.T @ ((w * (1 - d * d) / (1 + d * d) ** 2)[:, None] * h)).min() < 1
    with solve.SparseOperator(table, 4) as op:
        big = told.withColumn("weight", minimise.F.col("weight") * 40)
        found = minimise.truncated_newton(minimise.Cost(op, big, CAUCHY), tolerance=1e-5)
        assert found.bends > 0
        assert np.abs(gradient(h, d, 40 * w, state(found.point, 4), CAUCHY)).max() < 1e-2


@pytest.mark.parametrize("beta", list(minimise.BETAS))
def test_every_beta_reaches_the_minimum(spark, beta):
    h, d, w, table, told = problem(spark)
    direct = np.linalg.solve(np.eye(4) + h.T @ (w[:, None] * h), h.T @ (w * d))
    with solve.SparseOperator(table, 2) as op:
        found = minimise.nonlinear_conjugate_gradient(minimise.Cost(op, told), beta, tolerance=1e-4, exact=beta == "FR")
        assert np.allclose(state(found.point, 4), direct, atol=1e-2)


def test_line_searches(spark):
    h, d, w, table, told = problem(spark, far=2.0)
    with solve.SparseOperator(table, 2) as op:
        cost = minimise.Cost(op, told, CAUCHY)
        start = cost.start()
        direction = -gradient(h, d, w, np.zeros(4), CAUCHY)
        ray = minimise.Ray(cost, start)
        ray.steps([0.1, 0.2, 0.7])
        for t, (f, s) in ray.known.items():
            x = t * direction
            r = h @ x - d
            assert np.isclose(f, x @ x / 2 + (w * np.log1p(r * r) / 2).sum()) and np.isclose(s, gradient(h, d, w, x, CAUCHY) @ direction)
        assert ray.passes == 1
        for first in (1e-4, 1.0, 1e4):
            ray = minimise.Ray(cost, start)
            t = minimise.strong_wolfe(ray, first, curvature=0.05)
            f, s = ray.known[t]
            assert f <= ray.known[0.0][0] + 1e-4 * t * ray.known[0.0][1] and abs(s) <= 0.05 * -ray.known[0.0][1]
        ray = minimise.Ray(cost, start)
        t = minimise.line_minimum(ray, 1.0, 1e-10)
        assert abs(gradient(h, d, w, t * direction, CAUCHY) @ direction) < 1e-6 * (direction @ direction)
        with pytest.raises(ValueError):
            minimise.strong_wolfe(minimise.Ray(cost, start, 1.0))


def test_a_transform_changes_the_metric_not_the_rows(spark):
    """With x = C q the minimum is that of the cost in q: here C doubles every second column."""
    h, d, w, table, told = problem(spark)
    c = np.diag(np.where(np.arange(4) % 2 == 0, 2.0, 1.0))

    def double(v):
        return v.selectExpr("col", "v * CASE WHEN col % 2 = 0 THEN 2 ELSE 1 END AS v")

    hc = h @ c
    direct = np.linalg.solve(np.eye(4) + hc.T @ (w[:, None] * hc), hc.T @ (w * d))
    with solve.SparseOperator(table, 2) as op:
        found = minimise.truncated_newton(minimise.Cost(op, told, transform=minimise.Transform(double, double)), tolerance=1e-6)
        assert np.allclose(state(found.point, 4), direct, atol=1e-4)


def test_blocks_of_rows_multiply_and_move_no_entries(spark):
    """H'WH and H'Wd from blocks cut anywhere between rows; a product moves a value a block and column."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        h, d, w, table, told = problem(spark, rows=30)
        with solve.RowBlocks(table, told, 2, entries=5) as op:
            assert {r.col: pytest.approx(r.v) for r in op.goal().collect()} == dict(enumerate((h.T @ (w * d)).tolist()))
            p = spark.createDataFrame([(j, j + 1.0) for j in range(4)], "col int, p double")
            found = op.product(p)
            assert {r.col: pytest.approx(r.v) for r in found.collect()} == dict(enumerate((h.T @ (w * (h @ [1.0, 2.0, 3.0, 4.0]))).tolist()))
            blocks = spark.table(op.blocks).collect()
            assert len(blocks) > 2 and sum(len(b.h) for b in blocks) == table.count() and spark.table(op.routes).count() == sum(len(b.col) for b in blocks)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_rows_that_share_columns_move_less_than_their_entries(spark):
    """800 rows of four entries over 20 columns each hundred: a value a block and column, not one an entry."""
    table = spark.range(3200).selectExpr("id div 4 AS row", "(id div 400) * 20 + id % 20 AS col", "1.0D AS h")
    told = spark.range(800).selectExpr("id AS row", "1.0D AS d", "0.5D AS weight")
    with solve.RowBlocks(table, told, 8) as op:
        assert spark.table(op.routes).count() <= 8 * 20 * 2
    assert solve.conjugate_gradient(table, told).count() == 160
