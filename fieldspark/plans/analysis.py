"""Queries on the analysis itself: filters and splines along grid lines, minimisers and line searches."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import grid, lines, minimise, outer, solve, sparse
from ..sources.place import new_folder
from .algebra import CUBE
from .tables import SAMPLES, read, registered, rounded, samples


def _numbers(values) -> str:
    return ", ".join(f"{float(v)!r}::DOUBLE" for v in values)


def filter_sql(name: str, source: str, keys: str, place: str, n: int | str, scale: float) -> str:
    """Recursive CTEs, the last called name, with keys, place and v filtered along place; n is a number or a subquery."""
    c = lines.filter_coefficients(scale)
    a = [repr(float(w)) + "::DOUBLE" for w in c.weights]
    g = repr(c.gain) + "::DOUBLE"
    k = keys + ", " if keys else ""
    same = " AND ".join([f"p.{x.strip()} = q.{x.strip()}" for x in keys.split(",")] + ["TRUE"]) if keys else "TRUE"
    pk = "".join(f"p.{x.strip()}, " for x in keys.split(",")) if keys else ""
    ends = c.ends
    last = [" + ".join(f"{float(ends[r, j])!r}::DOUBLE * q{4 - j}" for j in range(4)) for r in range(4)]  # of places n-4 .. n-1
    return f"""{name}_q AS (SELECT {k}{place}, {g} * v AS q1, 0.0::DOUBLE AS q2, 0.0::DOUBLE AS q3, 0.0::DOUBLE AS q4 FROM {source} WHERE {place} = 0
        UNION ALL SELECT {pk}p.{place}, {g} * p.v + {a[0]} * q1 + {a[1]} * q2 + {a[2]} * q3 + {a[3]} * q4, q1, q2, q3 FROM {name}_q q JOIN {source} p ON p.{place} = q.{place} + 1 AND {same}
    ), {name}_e AS (SELECT {k}{last[0]} AS s1, {last[1]} AS s2, {last[2]} AS s3, {last[3]} AS s4 FROM {name}_q WHERE {place} = {n} - 1
    ), {name}_s AS (SELECT {k}{n} - 4 AS {place}, s1, s2, s3, s4 FROM {name}_e
        UNION ALL SELECT {pk}p.{place}, {g} * p.q1 + {a[0]} * q.s1 + {a[1]} * q.s2 + {a[2]} * q.s3 + {a[3]} * q.s4, q.s1, q.s2, q.s3 FROM {name}_s q JOIN {name}_q p ON p.{place} = q.{place} - 1 AND {same}
    ), {name} AS (SELECT {k}{place}, s1 AS v FROM {name}_s UNION ALL SELECT {k}{n} - 3, s2 FROM {name}_e UNION ALL SELECT {k}{n} - 2, s3 FROM {name}_e UNION ALL SELECT {k}{n} - 1, s4 FROM {name}_e)"""


@registered(f"""WITH RECURSIVE p AS (SELECT row_number() OVER (ORDER BY event_id) - 1 AS i, value / 100 AS v FROM events), {filter_sql("f", "p", "", "i", "(SELECT count(*) FROM events)", 3.0)}
    SELECT CAST(i AS INTEGER) AS place, round(v, 6) + 0 AS smooth FROM f""")
def win05_recursive_filter(spark, sf_dir):
    """All events, by their id, as one line: cut into blocks, summed up, and run through with what enters each."""
    rows = read(spark, sf_dir, "events").select("event_id", (F.col("value") / 100).alias("v"))
    counts = sparse.offsets(rows, "event_id").select("event_id", F.col("first").alias("place"))  # the rank, without a sort of all rows
    line = rows.join(counts, "event_id").select(F.lit(0).alias("line"), "place", "v")
    out = lines.recursive_filter(line, ["line"], "place", "v", 3.0, rows.count(), block=512)
    return rounded(out.select("place", F.col("v").alias("smooth")), "place", places=6)


_CELLS = f"""{SAMPLES}, ax AS (SELECT CAST(unnest(range(0, 21)) AS INTEGER) AS ix), ay AS (SELECT CAST(unnest(range(0, 21)) AS INTEGER) AS iy), az AS (SELECT CAST(unnest(range(0, 11)) AS INTEGER) AS iz
), g AS (SELECT ix, iy, iz, coalesce(sum(value) / 1000, 0) AS v FROM ax CROSS JOIN ay CROSS JOIN az LEFT JOIN samples ON floor(x) = ix AND floor(y) = iy AND floor(z / 5) = iz GROUP BY ALL)"""


def cells(spark, sf_dir):
    """Sums of the samples of each cell of a cube, zeros included."""
    rows = samples(spark, sf_dir)
    held = rows.groupBy(F.floor("x").cast("int").alias("ix"), F.floor("y").cast("int").alias("iy"), F.floor(F.col("z") / 5).cast("int").alias("iz")).agg((F.sum("value") / 1000).alias("v"))
    return grid.mesh(spark, CUBE).select("ix", "iy", "iz").join(held, ["ix", "iy", "iz"], "left").withColumn("v", F.coalesce("v", F.lit(0.0)))


SCALES = {"z": 1.5, "y": 2.0, "x": 2.5}


@registered(f"""WITH RECURSIVE {_CELLS}, {filter_sql("fz", "g", "ix, iy", "iz", 11, SCALES["z"])}, {filter_sql("fy", "fz", "ix, iz", "iy", 21, SCALES["y"])}, {filter_sql("fx", "fy", "iy, iz", "ix", 21, SCALES["x"])}
    SELECT CAST(ix AS INTEGER) AS ix, CAST(iy AS INTEGER) AS iy, CAST(iz AS INTEGER) AS iz, round(v * (1 + iz * 0.1::DOUBLE), 6) + 0 AS v FROM fx""")
def sol01_filtered_state(spark, sf_dir):
    """A state filtered along all three axes, times the background's deviation, which grows with height."""
    out = cells(spark, sf_dir)
    for axis, scale in SCALES.items():
        out = lines.recursive_filter(out, [f"i{a}" for a in CUBE if a != axis], f"i{axis}", "v", scale, CUBE[axis][0])
    return rounded(out.select("ix", "iy", "iz", (F.col("v") * (1 + F.col("iz") * 0.1)).alias("v")), "ix", "iy", "iz", places=6)


#: Of each axis: the cutoff wavelength, and the conditions at its ends.
SPLINES = {"z": (2.0, "R1T0", "R1T1"), "y": (2.0, "R0", "R0"), "x": (3.0, "R1T2", "R2T20")}


def _system(axis: str) -> lines.SplineSystem:
    cutoff, left, right = SPLINES[axis]
    return lines.SplineSystem.of(CUBE[axis][0], 1.0, cutoff, left, right)


def _matrix(name: str, whole, more: str = "") -> str:
    rows = ", ".join(f"({more}{i}, {j}, {float(whole[i, j])!r}::DOUBLE)" for i in range(len(whole)) for j in range(len(whole)))
    return f"{name} AS (SELECT * FROM (VALUES {rows}) t(i, j, m))"


def _spline_sql() -> str:
    parts, source = [], "g"
    for axis in SPLINES:
        others = ", ".join(f"i{a}" for a in CUBE if a != axis)
        parts.append(f"{_matrix('m' + axis, _system(axis).dense())}, s{axis} AS (SELECT {others}, CAST(i AS INTEGER) AS i{axis}, sum(m * v) AS v FROM {source} JOIN m{axis} ON j = i{axis} GROUP BY {others}, i)")
        source = f"s{axis}"
    return f"WITH {_CELLS}, {', '.join(parts)} SELECT ix, iy, iz, round(v, 6) + 0 AS v FROM {source}"


@registered(_spline_sql())
def sol02_spline_transform(spark, sf_dir):
    """Spline coefficients of a state on three axes, each with its cutoff and its conditions, by banded solves along the lines."""
    out = cells(spark, sf_dir)
    for axis in SPLINES:
        out = lines.spline_transform(out, [f"i{a}" for a in CUBE if a != axis], f"i{axis}", "v", _system(axis))
    return rounded(out.select("ix", "iy", "iz", "v"), "ix", "iy", "iz", places=6)


_KINDS = ["R0", "R1T0", "R1T1", "R1T2", "R2T10", "R2T20", "R3", "PERIODIC"]


def _kind(name: str) -> lines.SplineSystem:
    return lines.SplineSystem.of(21, 1.0, 2.5, name, name)


_KIND_ROWS = ", ".join(f"('{k}', {i}, {j}, {float(v)!r}::DOUBLE)" for k in _KINDS for i, row in enumerate(_kind(k).dense()) for j, v in enumerate(row))


@registered(f"""WITH {_CELLS}, k AS (SELECT * FROM (VALUES {_KIND_ROWS}) t(kind, i, j, m)), f AS (SELECT iy, ix, sum(v) AS v FROM g GROUP BY iy, ix)
    SELECT kind, iy, CAST(i AS INTEGER) AS ix, round(sum(m * v), 6) + 0 AS v FROM f JOIN k ON j = ix GROUP BY kind, iy, i""")
def sol04_boundary_conditions(spark, sf_dir):
    """Lines solved with each of the conditions at both ends; all but the periodic ones by a split solve over blocks of seven nodes."""
    plane, out = cells(spark, sf_dir).groupBy("iy", "ix").agg(F.sum("v").alias("v")), None
    for kind in _KINDS:
        one = lines.spline_transform(plane, ["iy"], "ix", "v", _kind(kind), block=21 if kind == "PERIODIC" else 7).withColumn("kind", F.lit(kind))
        out = one if out is None else out.unionByName(one)
    return rounded(out.select("kind", "iy", "ix", "v"), "kind", "iy", "ix", places=6)


def _problem(spark, sf_dir, col: str = "l_suppkey"):
    """Equations of orders in suppliers, or of the suppliers' nations in sizes of parts: the operator as a table, and what it should give."""
    items = read(spark, sf_dir, "lineitem")
    if col == "l_suppkey":
        h = items.groupBy(F.col("l_orderkey").alias("row"), F.col("l_suppkey").alias("col")).agg((F.sum("l_quantity") / 50).alias("h"))
        d = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("row"), (F.col("o_totalprice") / 100_000).alias("d"), F.lit(0.2).alias("weight"))
        return h, d
    part = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_size").alias("col"))
    home = read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").alias("row"))
    items = items.join(home, "l_suppkey").join(part, "l_partkey")
    h = items.groupBy("row", "col").agg((F.avg("l_quantity") / 50).alias("h"))
    return h, items.groupBy("row").agg((F.sum("l_extendedprice") / F.sum("l_quantity") / 1000).alias("d")).withColumn("weight", F.lit(0.5))


@registered("SELECT DISTINCT l_suppkey AS col, 0.0::DOUBLE AS gradient FROM lineitem")
def sol09_truncated_newton(spark, sf_dir):
    """The gradient where truncated Newton ends, worked out anew from its state: zero to five places."""
    h, d = _problem(spark, sf_dir)
    with solve.SparseOperator(h) as op:
        found = minimise.truncated_newton(minimise.Cost(op, d), tolerance=1e-9)
        return rounded(sparse.gradient(h, d, found.point.state.select("col", "x")).withColumnRenamed("g", "gradient"), "col", places=5)


_RAY = """i AS (SELECT s_nationkey AS row, p_size AS col, l_quantity, l_extendedprice FROM lineitem JOIN supplier ON s_suppkey = l_suppkey JOIN part ON p_partkey = l_partkey
), h AS (SELECT row, col, avg(l_quantity) / 50 AS h FROM i GROUP BY ALL
), d AS (SELECT row, sum(l_extendedprice) / sum(l_quantity) / 1000 AS d, 0.5::DOUBLE AS weight FROM i GROUP BY row
), g AS (SELECT col, sum(h * weight * d) AS p FROM h JOIN d USING (row) GROUP BY col), u AS (SELECT row, sum(h * p) AS u FROM h JOIN g USING (col) GROUP BY row
), s AS (SELECT (SELECT sum(p * p) FROM g) AS pp, (SELECT sum(weight * u * u) FROM u JOIN d USING (row)) AS uu, (SELECT sum(weight * d * d) / 2 FROM d) AS f0)"""


@registered(f"WITH {_RAY} SELECT round(pp / (pp + uu) * 1e6, 4) AS step, round(f0 - pp * pp / (pp + uu) / 2, 6) AS cost, 0.0::DOUBLE AS slope FROM s")
def sol12_line_minimum(spark, sf_dir):
    """The minimum along the steepest descent, in millionths of the gradient, with cost and slope there."""
    h, d = _problem(spark, sf_dir, "p_size")
    with solve.SparseOperator(h) as op:
        cost = minimise.Cost(op, d)
        ray = minimise.Ray(cost, cost.start())
        t = minimise.line_minimum(ray, 1e-6, 1e-12)
        value, slope = ray.known[t]
        return spark.range(1).select(F.round(F.lit(t * 1e6), 4).alias("step"), F.round(F.lit(value), 6).alias("cost"), (F.round(F.lit(slope / -ray.known[0.0][1]), 6) + 0.0).alias("slope"))


@registered(f"WITH {_RAY} SELECT 0.1::DOUBLE AS curvature, TRUE AS lower, TRUE AS flat FROM s UNION ALL SELECT 0.9, TRUE, TRUE FROM s")
def sol10_strong_wolfe(spark, sf_dir):
    """Steps from several passes over the rows, and whether cost and slope there, worked out anew, satisfy the strong Wolfe conditions."""
    h, d = _problem(spark, sf_dir, "p_size")
    told = []
    with solve.SparseOperator(h) as op:
        cost = minimise.Cost(op, d, minimise.CAUCHY)
        start = cost.start()
        for curvature in (0.1, 0.9):
            ray = minimise.Ray(cost, start)
            t = minimise.strong_wolfe(ray, 1.0, curvature=curvature)
            there = ray.moved(t)
            told.append((curvature, there.value <= start.value - 1e-4 * t * start.square, abs(there.sums["gp"]) <= curvature * start.square * (1 + 1e-9)))
    return spark.createDataFrame(told, "curvature double, lower boolean, flat boolean")


@registered("SELECT beta, col, 0.0::DOUBLE AS gradient FROM (SELECT DISTINCT p_size AS col FROM lineitem JOIN part ON p_partkey = l_partkey JOIN supplier ON s_suppkey = l_suppkey), (SELECT unnest(['FR', 'PR', 'PRP+', 'DY', 'HZ', 'DK']) AS beta)")
def sol11_nonlinear_betas(spark, sf_dir):
    """Each of the six rules for the next direction, on one cost: the gradient where it ends, relative to that at the start."""
    h, d = _problem(spark, sf_dir, "p_size")
    out = None
    with solve.SparseOperator(h) as op:
        for beta in minimise.BETAS:
            cost = minimise.Cost(op, d)
            first = cost.start().square ** 0.5
            found = minimise.nonlinear_conjugate_gradient(cost, beta, tolerance=1e-3).point
            one = found.state.select(F.lit(beta).alias("beta"), "col", (F.col("g") / first).alias("gradient"))
            out = one if out is None else out.unionByName(one)
    return rounded(out, "beta", "col", places=2)


@registered("SELECT DISTINCT p_size AS col, 0.0::DOUBLE AS gradient FROM lineitem JOIN part ON p_partkey = l_partkey JOIN supplier ON s_suppkey = l_suppkey")
def sol13_outer_iterations(spark, sf_dir):
    """The background fitted to half the weight of its samples, then two iterations with settings of their own: the gradient of the last step's cost, worked out anew."""
    h, d = _problem(spark, sf_dir, "p_size")
    weighted = [d.withColumn("weight", F.col("weight") * w) for w in (0.5, 1.0, 2.0)]
    steps = [lambda w=w: outer.Step(h, w, tolerance=1e-6) for w in weighted]
    found = outer.run(spark, new_folder(spark, "outer"), steps)
    field = solve.product(h, found, "x")
    miss = d.join(field, "row").select("row", (F.col("weight") * 2 * (F.col("v") - F.col("d"))).alias("v"))
    out = found.join(solve.transposed(h, miss), "col").select("col", (F.col("dx") + F.col("v")).alias("gradient"))
    return rounded(out, "col", places=4)
