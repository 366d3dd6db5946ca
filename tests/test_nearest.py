"""The search for nearest points by blocks: against brute force, and how its rows grow."""

from __future__ import annotations

import math

import numpy as np
import pytest

from fieldspark.operators import blocks, grid

TYPES = "id long, x double, y double, value double"


def _brute(rows, asked, k, reach):
    """(id, near_id, distance, place): rows of one id share one list, as they do in SQL."""
    told = []
    for i in sorted({r[0] for r in asked}):
        met = []
        for q in (r for r in asked if r[0] == i):
            for p in rows:
                if None not in (q[1], q[2], p[1], p[2]):
                    dx, dy = q[1] - p[1], q[2] - p[2]
                    d = math.sqrt(dx * dx + dy * dy)
                    if d <= reach:
                        met.append((d, p[0]))
        told += [(i, p, d, place) for place, (d, p) in enumerate(sorted(met)[:k], 1)]
    return told


def _found(spark, rows, asked, k, reach):
    found = grid.nearest(spark.createDataFrame(asked, TYPES), spark.createDataFrame(rows, TYPES), "x", "y", k, reach, "id", "id")
    return sorted((r.id, r.near_id, r.distance, r.place) for r in found.collect())


def _lattice():
    return [(i * 37 % 400, i % 20 * 0.25, i // 20 * 0.25, 1.0) for i in range(400)]


def _knots():
    rng = np.random.default_rng(1)
    spread, tight = rng.random((150, 2)) * 10, 3 + rng.normal(size=(150, 2)) * 1e-4
    same = np.tile([[7.0, 7.0]], (100, 1))
    return [(i, float(x), float(y), 1.0) for i, (x, y) in enumerate(rng.permutation(np.vstack([spread, tight, same])))]


def _odd():
    rows = [(i // 2, (i * 7 % 40) / 4, (i * 11 % 36) / 4, 1.0) for i in range(200)]  # every id twice
    rows += [(300, None, 1.0, 1.0), (301, 1.0, None, 1.0), (302, float("nan"), 1.0, 1.0), (303, float("inf"), 1.0, 1.0), (304, 1.0, -float("inf"), 1.0), (305, -0.0, 0.0, 1.0), (306, 0.0, -0.0, 1.0)]
    return rows + [(307, 1e200, 1e200, 1.0), (308, -500.0, 3.0, 1.0)]


@pytest.mark.parametrize(("made", "k", "reach"), [(_lattice, 4, 2.0), (_lattice, 7, 0.3), (_knots, 4, 2.0), (_knots, 3, 0.05), (_odd, 4, 2.0), (_odd, 1, 1e9)])
def test_nearest_equals_brute_force(spark, monkeypatch, made, k, reach):
    monkeypatch.setattr(blocks, "POINTS", 20)
    rows = made()
    asked = [r for r in rows if r[0] % 3 == 0 or r[0] > 299]
    assert _found(spark, rows, asked, k, reach) == sorted(_brute(rows, asked, k, reach))


def test_few_points_and_none(spark):
    rows = [(1, 0.0, 0.0, 1.0), (2, 1.0, 0.0, 1.0)]
    assert _found(spark, rows, [(9, 0.25, 0.0, 0.0), (8, 50.0, 0.0, 0.0)], 4, 2.0) == [(9, 1, 0.25, 1), (9, 2, 0.75, 2)]
    assert _found(spark, [], rows, 4, 2.0) == _found(spark, rows, [], 4, 2.0) == []


def test_what_comes_with_a_point_keeps_its_type(spark):
    rows = spark.sql("SELECT CAST(id AS STRING) AS id, id * 1.0D AS x, 0.0D AS y, IF(id = 1, NULL, id) AS n, CAST(id AS DECIMAL(20, 3)) AS d, timestamp_seconds(id) AS t, array(id) AS a FROM range(3)")
    found = grid.nearest(rows.where("id = '0'"), rows, "x", "y", 2, 5.0, "id", "id")
    assert found.columns == ["id", "near_id", "n", "d", "t", "a", "distance", "place"]
    assert [f.dataType for f in found.select("n", "d", "t", "a").schema] == [f.dataType for f in rows.select("n", "d", "t", "a").schema]
    told = {r.id: r for r in rows.collect()}
    for r in found.collect():
        assert (r.n, r.d, r.t, r.a) == (told[r.near_id].n, told[r.near_id].d, told[r.near_id].t, told[r.near_id].a)


def _nodes(plan):
    yield plan
    name = plan.getClass().getSimpleName()
    inner = plan.executedPlan() if name == "AdaptiveSparkPlanExec" else plan.plan() if name.endswith("QueryStageExec") else None
    below = [inner] if inner is not None else [plan.children().apply(i) for i in range(plan.children().size())]
    for one in below:
        yield from _nodes(one)


def test_no_step_makes_a_row_for_every_point_within_reach(spark, monkeypatch):
    """4000 points, 200 queries, all within reach of each other: 800 000 pairs, of which no step may make rows."""
    monkeypatch.setattr(blocks, "POINTS", 256)
    rng = np.random.default_rng(2)
    rows = spark.createDataFrame([(i, float(x), float(y), 1.0) for i, (x, y) in enumerate(rng.random((4000, 2)))], TYPES)
    found = grid.nearest(rows.where("id % 20 = 0"), rows, "x", "y", 4, 2.0, "id", "id")
    assert len(found.collect()) == 800
    counted = [m.get().value() for n in _nodes(found._jdf.queryExecution().executedPlan()) if (m := n.metrics().get("numOutputRows")).isDefined()]
    assert counted and max(counted) <= 8000


def test_blocks_hold_few_points_and_are_reached_by_every_point_near(spark):
    rng = np.random.default_rng(4)
    xy = np.vstack([rng.random((500, 2)), 0.5 + rng.normal(size=(500, 2)) * 1e-9, np.full((100, 2), 0.25)])
    tree = blocks.cut(xy, 16)
    held = tree.holding(xy)
    for b in np.unique(held):
        assert tree.axis[b] == -1
        assert (held == b).sum() <= 16 or len(np.unique(xy[held == b], axis=0)) == 1
    bound = rng.random(len(xy)) * 0.1
    who, block = tree.within(xy, bound)
    told = set(zip(who.tolist(), block.tolist(), strict=True))
    assert len(told) == len(who)
    for i in range(0, len(xy), 50):
        near = blocks.apart(xy[:, 0] - xy[i, 0], xy[:, 1] - xy[i, 1]) <= bound[i]
        assert {(i, b) for b in held[near].tolist()} <= told
