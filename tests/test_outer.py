"""Outer iterations: against numpy, and a run that dies and goes on."""

from __future__ import annotations

import numpy as np
import pytest
from test_minimise import problem

from fieldspark.operators import outer


def test_a_run_that_died_goes_on(spark, tmp_path):
    h, d, w, table, told = problem(spark)
    path, solved = f"file://{tmp_path}/run", []

    def step(k, weight, fails=False):
        def made():
            if fails:
                raise RuntimeError("stopped")
            solved.append(k)
            return outer.Step(table, told.withColumn("weight", outer.F.col("weight") * weight), tolerance=1e-7)

        return made

    with pytest.raises(RuntimeError, match="stopped"):
        outer.run(spark, path, [step(0, 0.5), step(1, 1.0), step(2, 2.0, fails=True)])
    assert solved == [0, 1] and outer.finished(spark, path) == 2
    spark.createDataFrame([(1,)], "half long").write.parquet(f"{path}/step-2/_temporary/0")  # what a step that died within its job leaves
    out = outer.run(spark, path, [step(0, 0.5), step(1, 1.0), step(2, 2.0)])
    assert solved == [0, 1, 2]
    x = np.zeros(4)
    for weight in (0.5, 1.0, 2.0):
        x = x + np.linalg.solve(np.eye(4) + h.T @ ((weight * w)[:, None] * h), h.T @ (weight * w * (d - h @ x)))
    got = {r.col: r.x for r in out.collect()}
    assert np.allclose([got[c] for c in range(4)], x, atol=1e-4)
