"""Minimisers of a cost on tables: truncated Newton, nonlinear conjugate gradients, and their line searches.

The cost of a state x is half of |x|^2 plus the sum over rows of weight times
a loss of (H x - d).  State and gradient are tables by column, rows keep H x
beside them; along a direction p the cost of any number of trial steps is one
aggregate over the rows, once H p stands there.  Only such sums come to the
driver, which decides by them.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .solve import RowBlocks, SparseOperator, settled


@dataclass(frozen=True)
class Loss:
    """A loss of the residual, its slope and its bend, as column expressions; even: the bend is 1 everywhere."""

    value: Callable[[Column], Column]
    slope: Callable[[Column], Column]
    bend: Callable[[Column], Column]
    even: bool = False


SQUARE = Loss(lambda r: r * r / 2, lambda r: r, lambda r: F.lit(1.0), even=True)
#: Grows with the logarithm of the residual: outliers pull less; not convex from a residual of 1 on.
CAUCHY = Loss(lambda r: F.log1p(r * r) / 2, lambda r: r / (1 + r * r), lambda r: (1 - r * r) / ((1 + r * r) * (1 + r * r)))


@dataclass(frozen=True)
class Transform:
    """What maps the state to the field that H sees, as a symmetric operator or with its adjoint; both take and give (col, v)."""

    apply: Callable[[DataFrame], DataFrame]
    adjoint: Callable[[DataFrame], DataFrame]


#: Sums over the state's table, by which directions are chosen: of the state x, its gradient g, the last direction p, and y, what it changed of g.
SUMS = {"xx": "x * x", "xg": "x * g", "xp": "x * p", "gg": "g * g", "gp": "g * p", "pp": "p * p", "gy": "g * (g - g0)", "yy": "(g - g0) * (g - g0)", "py": "p * (g - g0)", "g0g0": "g0 * g0"}


@dataclass
class Point:
    """A state with its gradient, the direction that led to it and the gradient before (col, x, g, p, g0); the rows (row, d, weight, v), v the field seen."""

    state: DataFrame
    rows: DataFrame
    value: float
    sums: dict[str, float]

    @property
    def square(self) -> float:
        return self.sums["gg"]


class Cost:
    """The cost of h (row, col, h) and d (row, d, weight); rows of d that H does not reach see zero."""

    def __init__(self, operator: SparseOperator, d: DataFrame, loss: Loss = SQUARE, transform: Transform | None = None, columns: DataFrame | None = None):
        self.operator, self.loss, self.transform = operator, loss, transform
        self.d = settled(d.select("row", "d", "weight"))
        self.columns = settled(columns or operator.columns())
        self.blocks: RowBlocks | None = None

    def seen(self, x: DataFrame) -> DataFrame:
        """(row, v) of the field of (col, v)."""
        return self.operator.product(self.transform.apply(x) if self.transform else x, "v")

    def back(self, y: DataFrame) -> DataFrame:
        """(col, v): the adjoint of seen."""
        out = self.operator.transposed(y)
        return self.transform.adjoint(self.columns.join(out, "col", "left").select("col", F.coalesce("v", F.lit(0.0)).alias("v"))) if self.transform else out

    def start(self) -> Point:
        zero = self.columns.select("col", *[F.lit(0.0).alias(c) for c in ("x", "p", "g0")])
        value = self.d.agg(F.sum(F.col("weight") * self.loss.value(-F.col("d")))).first()[0] or 0.0
        return self.at(zero, self.d.withColumn("v", F.lit(0.0)), value)

    def at(self, state: DataFrame, rows: DataFrame, value: float) -> Point:
        """The point of a state (col, x, p, g0) of known cost, whose rows hold what it sees."""
        miss = F.col("v") - F.col("d")
        back = self.back(rows.select("row", (F.col("weight") * self.loss.slope(miss)).alias("v")))
        found = settled(state.join(back, "col", "left").select("col", "x", (F.col("x") + F.coalesce("v", F.lit(0.0))).alias("g"), "p", "g0"))
        sums = found.agg(*[F.coalesce(F.sum(F.expr(e)), F.lit(0.0)).alias(n) for n, e in SUMS.items()]).first().asDict()
        return Point(found, rows, value, sums)

    def bent(self, point: Point, p: DataFrame) -> DataFrame:
        """p (col, p, ...) with q, the Hessian at the point times p."""
        if self.loss.even and not self.transform:  # the same at every point: rows need not be told
            self.blocks = self.blocks or self.operator.row_blocks(self.d)
            return p.join(self.blocks.product(p), "col", "left").select(*p.columns, (F.col("p") + F.coalesce("v", F.lit(0.0))).alias("q"))
        seen = self.seen(p.select("col", F.col("p").alias("v"))).withColumnRenamed("v", "u")
        miss = F.col("v") - F.col("d")
        weighted = point.rows.join(seen, "row").select("row", (F.col("weight") * self.loss.bend(miss) * F.col("u")).alias("v"))
        return p.join(self.back(weighted), "col", "left").select(*p.columns, (F.col("p") + F.coalesce("v", F.lit(0.0))).alias("q"))


class Ray:
    """The cost from a point along the direction a * g + b * p of its columns; steps(ts) costs all trial steps in one pass over the rows."""

    def __init__(self, cost: Cost, point: Point, a: float = -1.0, b: float = 0.0):
        self.cost, self.point = cost, point
        self.direction = a * F.col("g") + b * F.col("p")
        seen = cost.seen(point.state.select("col", self.direction.alias("v"))).withColumnRenamed("v", "u")
        self.rows = settled(point.rows.join(seen, "row", "left").withColumn("u", F.coalesce("u", F.lit(0.0))))
        s = point.sums
        self.xp, self.pp = a * s["xg"] + b * s["xp"], a * a * s["gg"] + 2 * a * b * s["gp"] + b * b * s["pp"]
        self.known: dict[float, tuple[float, float]] = {0.0: (point.value, a * s["gg"] + b * s["gp"])}
        self.passes = 0

    def steps(self, ts: list[float]) -> None:
        """Adds value and slope at ts to what is known."""
        ts = sorted({float(t) for t in ts} - set(self.known))
        if not ts:
            return
        self.passes += 1
        sums = []
        for k, t in enumerate(ts):
            miss = F.col("v") + t * F.col("u") - F.col("d")
            sums += [F.sum(F.col("weight") * self.cost.loss.value(miss)).alias(f"f{k}"), F.sum(F.col("weight") * self.cost.loss.slope(miss) * F.col("u")).alias(f"s{k}")]
        told = self.rows.agg(*sums).first()
        for k, t in enumerate(ts):
            self.known[t] = (self.point.sums["xx"] / 2 + t * self.xp + t * t * self.pp / 2 + (told[f"f{k}"] or 0.0), self.xp + t * self.pp + (told[f"s{k}"] or 0.0))

    def moved(self, t: float) -> Point:
        """The point at a step that has been costed."""
        state = self.point.state.select("col", (F.col("x") + t * self.direction).alias("x"), self.direction.alias("p"), F.col("g").alias("g0"))
        return self.cost.at(state, self.rows.select("row", "d", "weight", (F.col("v") + t * F.col("u")).alias("v")), self.known[t][0])


def _between(ray: Ray, low: float, high: float, many: int = 4) -> list[float]:
    """Trial steps inside a bracket: the minimum of the cubic through its ends, where it has one, and steps that cut it evenly."""
    (f0, s0), (f1, s1), width = ray.known[low], ray.known[high], high - low
    out = [low + width * k / (many + 1) for k in range(1, many + 1)]
    d = s0 + s1 - 3 * (f1 - f0) / width
    under = d * d - s0 * s1
    if under >= 0 and s1 - s0 + 2 * np.sqrt(under) != 0:
        t = high - width * (s1 + np.sqrt(under) - d) / (s1 - s0 + 2 * np.sqrt(under))
        if low + 0.01 * width < t < high - 0.01 * width:
            out.append(float(t))
    return out


def _bracket(ray: Ray, first: float, ends: Callable[[float, float], bool], rounds: int = 12) -> tuple[float, float]:
    """Neighbouring known steps between which a minimum lies: the first where ends(previous, step) holds; steps grow up to there."""
    reach = first
    for _ in range(rounds):
        ray.steps([reach * 4.0**k for k in range(-4, 5)])
        ts = sorted(ray.known)
        for a, b in zip(ts[:-1], ts[1:], strict=True):
            if ends(a, b):
                return a, b
        reach *= 4.0**8
    raise RuntimeError("the cost falls without end along the direction")


def strong_wolfe(ray: Ray, first: float = 1.0, decrease: float = 1e-4, curvature: float = 0.9, rounds: int = 30) -> float:
    """A step with enough decrease and a slope of at most curvature times that at 0, after a safeguarded bracketing.

    Of the steps of a pass that satisfy both, the one of least cost.
    """
    f0, s0 = ray.known[0.0]
    if s0 >= 0:
        raise ValueError("not a direction of descent")

    def good(t: float) -> bool:
        f, s = ray.known[t]
        return t > 0 and f <= f0 + decrease * t * s0 and abs(s) <= curvature * -s0

    def best() -> float | None:
        return min(filter(good, ray.known), key=lambda t: ray.known[t][0], default=None)

    def ends(a: float, b: float) -> bool:
        f, s = ray.known[b]
        return f > f0 + decrease * b * s0 or f >= ray.known[a][0] or s >= 0

    low, high = _bracket(ray, first, ends)
    for _ in range(rounds):
        if (t := best()) is not None:
            return t
        ray.steps(_between(ray, low, high))
        ts = [t for t in sorted(ray.known) if low <= t <= high]
        low, high = next((a, b) for a, b in zip(ts[:-1], ts[1:], strict=True) if ends(a, b))
        if high - low <= 1e-14 * max(high, 1.0):
            break
    t = min(ray.known, key=lambda t: ray.known[t][0])
    if t > 0:  # the bracket has shrunk to the cost's own rounding
        return t
    raise RuntimeError("no step lowers the cost")


def line_minimum(ray: Ray, first: float = 1.0, tolerance: float = 1e-8, rounds: int = 60) -> float:
    """The step to a minimum along the ray, from a bracket whose ends fall and rise, narrowed by cubics and even cuts."""
    if ray.known[0.0][1] >= 0:
        raise ValueError("not a direction of descent")

    def ends(a: float, b: float) -> bool:
        return ray.known[a][1] < 0 <= ray.known[b][1]

    low, high = _bracket(ray, first, ends)
    flat = tolerance * -ray.known[0.0][1]
    for _ in range(rounds):
        if high - low <= tolerance * high or min(abs(ray.known[low][1]), abs(ray.known[high][1])) <= flat:
            break
        ray.steps(_between(ray, low, high))
        ts = [t for t in sorted(ray.known) if low <= t <= high]
        low, high = next((a, b) for a, b in zip(ts[:-1], ts[1:], strict=True) if ends(a, b))
    return low if abs(ray.known[low][1]) < abs(ray.known[high][1]) and low > 0 else high


@dataclass
class Minimum:
    """Where a minimiser ended: the point, its outer and inner iterations, and how many times it met a direction of negative curvature."""

    point: Point
    outer: int
    inner: int = 0
    bends: int = 0


def truncated_newton(cost: Cost, iterations: int = 50, tolerance: float = 1e-4, inner: int = 200) -> Minimum:
    """Newton steps that conjugate gradients solve only as far as the gradient is small, and a line search along each.

    The inner loop ends when its residual is min(1/2, sqrt(|g|/|g0|)) of the
    gradient, or at a direction p along which the cost bends down: the step is
    what has been found before it, or the steepest descent where it is the
    first.  Ends when the gradient's norm is tolerance times that at the start.
    """
    point = cost.start()
    first, found = point.square, Minimum(point, 0)
    for turn in range(iterations):
        found.point, found.outer = point, turn
        if point.square <= first * tolerance**2 or point.square == 0:
            return found
        forcing = min(0.5, (point.square / first) ** 0.25)
        step = settled(point.state.select("col", F.lit(0.0).alias("s"), (-F.col("g")).alias("r"), (-F.col("g")).alias("p")))
        rr = point.square
        for k in range(inner):
            met = settled(cost.bent(point, step))
            sums = met.agg(F.sum(F.col("p") * F.col("q")).alias("pq"), F.sum(F.col("p") ** 2).alias("pp"), F.sum(F.col("r") * F.col("q")).alias("rq"), F.sum(F.col("q") ** 2).alias("qq")).first()
            if sums.pq <= 1e-12 * sums.pp:
                found.bends += 1
                if k == 0:
                    step = step.withColumn("s", F.col("p"))
                break
            found.inner += 1
            along = rr / sums.pq
            left = max(rr - 2 * along * sums.rq + along**2 * sums.qq, 0.0)
            r = F.col("r") - along * F.col("q")
            step = met.select("col", (F.col("s") + along * F.col("p")).alias("s"), r.alias("r"), (r + left / rr * F.col("p")).alias("p"))
            rr = left
            if rr <= forcing**2 * point.square:
                break
        state = settled(point.state.select("col", "x", "g", "g0").join(step.select("col", F.col("s").alias("p")), "col"))
        sums = state.agg(F.sum(F.expr("x * p")).alias("xp"), F.sum(F.expr("g * p")).alias("gp"), F.sum(F.expr("p * p")).alias("pp")).first().asDict()
        ray = Ray(cost, Point(state, point.rows, point.value, point.sums | sums), 0.0, 1.0)
        point = ray.moved(strong_wolfe(ray))
    raise RuntimeError(f"the minimiser did not reach its tolerance in {iterations} iterations")


#: The factor of the last direction p in the next, by name; from SUMS.
BETAS: dict[str, Callable[[dict[str, float]], float]] = {
    "FR": lambda s: s["gg"] / s["g0g0"],
    "PR": lambda s: s["gy"] / s["g0g0"],
    "PRP+": lambda s: max(s["gy"] / s["g0g0"], 0.0),
    "DY": lambda s: s["gg"] / s["py"],
    "HZ": lambda s: max((s["gy"] - 2 * s["yy"] / s["py"] * s["gp"]) / s["py"], -1 / (np.sqrt(s["pp"]) * min(0.01, np.sqrt(s["g0g0"])))),
    "DK": lambda s: max((s["gy"] - s["yy"] / s["py"] * s["gp"]) / s["py"], 0.5 * s["gp"] / s["pp"]),
}


def nonlinear_conjugate_gradient(cost: Cost, beta: str = "PRP+", iterations: int = 200, tolerance: float = 1e-4, exact: bool = False) -> Minimum:
    """Conjugate gradients for any loss, with one of BETAS; starts anew where a direction would not fall.

    Steps satisfy the strong Wolfe conditions, or with exact are minima along
    their direction.  Of an iteration the tables see one product each way, two
    or three passes of trial steps, and one of sums.
    """
    point = cost.start()
    first, step = point.square, 1.0
    for turn in range(iterations):
        s = point.sums
        if s["gg"] <= first * tolerance**2 or s["gg"] == 0:
            return Minimum(point, turn)
        factor = BETAS[beta](s) if turn and s["py"] > 0 else 0.0
        if -s["gg"] + factor * s["gp"] > -1e-10 * s["gg"]:
            factor = 0.0
        ray = Ray(cost, point, -1.0, factor)
        step = line_minimum(ray, step) if exact else strong_wolfe(ray, step, curvature=0.1)
        point = ray.moved(step)
    raise RuntimeError(f"the minimiser did not reach its tolerance in {iterations} iterations")
