"""Linear recurrences along the lines of a grid: the recursive filter, and spline systems with boundary conditions.

A line is cut into blocks of places.  What a block does to the few values
before it is an affine map: a matrix that depends on the block's size alone,
and a vector that the block gives from silence.  So blocks are summed up where
they are, the sums of a line are scanned, and every block runs once more with
what enters it: no task holds a line, and a line of a million places sends one
row a block to the scan.  A line that fits a block needs no scan.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .solve import settled

BLOCK = 4096
#: Values that a task works on at once.
CHUNK = 1 << 20


@dataclass(frozen=True)
class Recurrence:
    """y[m] = gain[m] * p[m] + the sum of weights[m, k] * y[m - 1 - k]; one row for every place of a line, or one for all."""

    gain: np.ndarray
    weights: np.ndarray

    @property
    def order(self) -> int:
        return self.weights.shape[1]

    def run(self, first: int, p: np.ndarray, state: np.ndarray) -> np.ndarray:
        """y of rows of p, whose places begin at first; state holds the values before them, the latest first."""
        n, order = p.shape[1], self.order
        y = np.empty((len(p), n + order))
        y[:, :order] = state[:, ::-1]
        varies = len(self.gain) > 1
        for m in range(n):
            at = first + m if varies else 0
            y[:, order + m] = self.gain[at] * p[:, m] + y[:, m : m + order] @ self.weights[at][::-1]
        return y[:, order:]

    def after(self, y: np.ndarray, state: np.ndarray) -> np.ndarray:
        """The state that y leaves behind."""
        return np.concatenate([state[:, ::-1], y], axis=1)[:, : -self.order - 1 : -1]

    def carry(self, first: int, n: int) -> np.ndarray:
        """What n silent places make of a state, as a matrix."""
        unit = np.eye(self.order)
        if len(self.gain) > 1:
            return self.after(self.run(first, np.zeros((self.order, n)), unit), unit).T
        one = np.vstack([self.weights[0], np.eye(self.order)[:-1]])
        return np.linalg.matrix_power(one, n)


@dataclass(frozen=True)
class Cut:
    """How lines of one length are cut; the last block is never shorter than least."""

    length: int
    block: int = BLOCK
    least: int = 4

    @property
    def last(self) -> int:
        return max((self.length - self.least) // self.block, 0)

    def bounds(self, k: int) -> tuple[int, int]:
        return k * self.block, self.length if k == self.last else (k + 1) * self.block


def to_blocks(rows: DataFrame, keys: list[str], place: str, value: str, cut: Cut) -> DataFrame:
    """keys, block, values: NULL counts as zero; a line with a missing or repeated place fails the job."""
    block = F.least(F.floor(F.col(place) / cut.block), F.lit(cut.last)).cast("int")
    each = F.array_sort(F.collect_list(F.struct(F.col(place).cast("long").alias("at"), F.coalesce(F.col(value).cast("double"), F.lit(0.0)).alias("v"))))
    made = rows.groupBy(*keys, block.alias("block")).agg(each.alias("each"))
    first = F.col("block").cast("long") * cut.block
    size = F.when(F.col("block") == cut.last, cut.length - first).otherwise(cut.block)
    whole = (F.size("each") == size) & (F.col("each")[0]["at"] == first) & (F.element_at("each", -1)["at"] == first + size - 1)
    values = F.transform("each", lambda x: x["v"])
    return made.select(*keys, "block", F.when(whole, values).otherwise(F.raise_error(F.lit("a line has a missing or a repeated place"))).cast("array<double>").alias("values"))


def from_blocks(blocks: DataFrame, keys: list[str], place: str, value: str, cut: Cut) -> DataFrame:
    told = blocks.select(*keys, "block", F.posexplode("values").alias("at", value))
    return told.select(*keys, (F.col("at") + F.col("block").cast("long") * cut.block).cast("int").alias(place), value)


def _alike(arrays: list[np.ndarray], of: list[int], work) -> list[np.ndarray]:
    """work(of, matrix) over arrays of one size and one of at a time, in chunks; its rows in the order of arrays."""
    out, shapes = [None] * len(arrays), {}
    for k, (a, o) in enumerate(zip(arrays, of, strict=True)):
        shapes.setdefault((o, len(a)), []).append(k)
    for (o, n), found in shapes.items():
        step = max(1, CHUNK // max(n, 1))
        for at in range(0, len(found), step):
            some = found[at : at + step]
            for k, row in zip(some, work(o, np.stack([arrays[k] for k in some]), some), strict=True):
                out[k] = row
    return out


def _mapped(fn, *columns: str) -> Column:
    return F.pandas_udf(fn, "array<double>")(*[F.col(c) for c in columns])


def swept(blocks: DataFrame, keys: list[str], recurrence: Recurrence, cut: Cut, backwards: bool = False) -> DataFrame:
    """blocks after the recurrence along whole lines, from silence; backwards it runs from the last place to the first.

    Places of a recurrence that varies count in the direction of the sweep.
    """
    order, last = recurrence.order, cut.last

    def start(k: int) -> int:
        if len(recurrence.gain) == 1:
            return 0
        a, b = cut.bounds(k)
        return cut.length - b if backwards else a

    def turned(a: np.ndarray) -> np.ndarray:
        return a[:, ::-1] if backwards else a

    def final(block: pd.Series, values: pd.Series) -> pd.Series:
        none = np.zeros((1, order))
        return pd.Series(_alike(list(values), [start(k) for k in block], lambda first, p, _: recurrence.after(recurrence.run(first, turned(p), np.repeat(none, len(p), 0)), np.repeat(none, len(p), 0))))

    def applied(block: pd.Series, values: pd.Series, state: pd.Series) -> pd.Series:
        states = np.array([np.zeros(order) if s is None else s for s in state])
        return pd.Series(_alike(list(values), [start(k) for k in block], lambda first, p, some: turned(recurrence.run(first, turned(p), states[some]))))

    if last == 0:
        return blocks.withColumn("state", F.lit(None).cast("array<double>")).withColumn("values", _mapped(applied, "block", "values", "state")).drop("state")
    blocks = settled(blocks)
    turn = F.lit(last) - F.col("block") if backwards else F.col("block")
    sums = blocks.select(*keys, turn.alias("turn"), _mapped(final, "block", "values").alias("c"))
    line = sums.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("turn", "c"))).alias("sums"))  # a row a block

    def entering(found: pd.Series) -> pd.Series:
        """For each line, the states that enter its blocks, in turn."""
        carries: dict[tuple[int, int], np.ndarray] = {}
        state, out = np.zeros((len(found), order)), [[] for _ in found]
        for t in range(last + 1):
            k = last - t if backwards else t
            a, b = cut.bounds(k)
            at = (start(k), b - a)
            if at not in carries:
                carries[at] = recurrence.carry(*at)
            for line_, s in zip(out, state, strict=True):
                line_.append(s)
            state = state @ carries[at].T + np.array([f[t]["c"] for f in found])
        return pd.Series(out)

    states = line.withColumn("states", F.pandas_udf(entering, "array<array<double>>")("sums")).select(*keys, F.posexplode("states").alias("turn", "state"))
    entry = states.withColumn("block", (F.lit(last) - F.col("turn") if backwards else F.col("turn")).cast("int")).drop("turn")
    return blocks.join(entry, [*keys, "block"]).withColumn("values", _mapped(applied, "block", "values", "state")).drop("state")


# -- the recursive filter

ORDER = 4
#: The factor's row that stands for those of an endless line.
SETTLED = 200


@dataclass(frozen=True)
class FilterCoefficients:
    gain: float
    weights: np.ndarray  # of the last one, two, three and four values
    ends: np.ndarray  # the last four of the backward sweep from the last four of the forward one


def filter_coefficients(scale: float) -> FilterCoefficients:
    """A quasi-Gaussian filter of fourth order whose length scale is given in places.

    exp(scale^2 k^2 / 2) is written in powers of the second difference, cut
    after the fourth, and factored; see Purser et al., "Numerical aspects of
    the application of recursive filters to variational statistical analysis", 2003.
    """
    square = np.array([0, 1, 1 / 12, 1 / 90, 1 / 560])  # of the wave number, in powers of the second difference
    power, known = np.array([1.0, 0, 0, 0, 0]), np.zeros(ORDER + 1)
    for m in range(ORDER + 1):
        known += power * (scale**2 / 2) ** m / np.prod(np.arange(1, m + 1))
        power = np.convolve(power, square)[: ORDER + 1]
    stencil, difference = np.zeros(2 * ORDER + 1), np.array([1.0])
    for n in range(ORDER + 1):
        stencil[ORDER - n : ORDER + n + 1] += (-1) ** n * known[n] * difference
        difference = np.convolve(difference, [1.0, -2.0, 1.0])
    whole = sum(np.diag(np.full(SETTLED + 1 - abs(d), stencil[ORDER + d]), d) for d in range(-ORDER, ORDER + 1))
    row = np.linalg.cholesky(whole)[SETTLED]
    gain = 1 / row[SETTLED]
    weights = -gain * row[SETTLED - 1 : SETTLED - ORDER - 1 : -1]
    lower = np.eye(ORDER) - sum(w * np.eye(ORDER, k=-k) for k, w in enumerate(weights, 1))
    upper = sum(weights[ORDER - 1 - j] * np.eye(ORDER, k=j) for j in range(ORDER))
    # nothing lies beyond the end: what an endless line would give its last four
    ends = np.linalg.inv((lower.T - upper.T @ np.linalg.solve(lower, upper)) / gain)
    return FilterCoefficients(float(gain), weights, ends)


def recursive_filter(rows: DataFrame, keys: list[str], place: str, value: str, scale: float, length: int, block: int = BLOCK) -> DataFrame:
    """keys, place and the filtered value of lines of one length, whose places run from 0 without gaps.

    Forward, then backward from the four last values that an endless line
    would have.  The sum of a line is kept but for what leaves its ends.
    Lines of fewer than four places, or a scale not above 0, stay as they are.
    """
    kept = rows.select(*keys, F.col(place).cast("int").alias(place), F.coalesce(F.col(value).cast("double"), F.lit(0.0)).alias(value))
    if length < ORDER or scale <= 0:
        return kept
    c = filter_coefficients(scale)
    recurrence = Recurrence(np.array([c.gain]), c.weights[None, :])
    cut = Cut(length, block, ORDER)

    def at_end(block: pd.Series, values: pd.Series) -> pd.Series:
        """Inputs of the backward sweep: the four last such that it starts with the ends' values."""
        out = []
        for k, v in zip(block, values, strict=True):
            if k == cut.last:
                v = v.copy()
                s = (c.ends @ v[-ORDER:])[::-1]
                own = [(s[r] - sum(c.weights[j] * s[r - 1 - j] for j in range(r))) / c.gain for r in range(ORDER)]
                v[-ORDER:] = own[::-1]
            out.append(v)
        return pd.Series(out)

    blocks = swept(to_blocks(kept, keys, place, value, cut), keys, recurrence, cut)
    blocks = blocks.withColumn("values", _mapped(at_end, "block", "values"))
    return from_blocks(swept(blocks, keys, recurrence, cut, backwards=True), keys, place, value, cut)


# -- spline systems

#: Boundary conditions by name: how many nodes the condition takes away at an end, and what the removed nodes add to those that stay,
#: as (row, column, coefficient) counted from the end.  Fixed values.
CONDITIONS = {
    "R0": (0, ()),
    "R1T0": (1, ((0, 0, -4.0), (1, 0, -1.0))),
    "R1T1": (1, ((1, 0, 1.0),)),
    "R1T2": (1, ((0, 0, 2.0), (1, 0, -1.0))),
    "R2T10": (2, ((0, 0, 1.0), (0, 1, -0.5))),
    "R2T20": (2, ((0, 0, -1.0),)),
    "R3": (3, ()),
    "PERIODIC": (1, ()),
}
BAND = 3


def folding(n: int, left: str, right: str) -> np.ndarray:
    """The matrix that folds the n nodes of a line into those that its conditions leave."""
    a, b = CONDITIONS[left], CONDITIONS[right]
    if "PERIODIC" in (left, right):
        if left != right:
            raise ValueError("a line is periodic at both ends or at none")
        m = n - 3
        g = np.eye(m, n, k=1)
        g[m - 1, 0] = g[0, n - 2] = g[1, n - 1] = 1.0
        return g
    m = n - a[0] - b[0]
    g = np.eye(m, n, k=a[0])
    for row, column, value in a[1]:
        g[row, column] = value
    for row, column, value in b[1]:
        g[m - 1 - row, n - 1 - column] = value
    return g


def _basis(z: np.ndarray, derivative: int) -> np.ndarray:
    size = np.abs(z)
    if derivative == 3:
        return np.where(size < 2, np.where(size > 1, 1.0, -3.0) * np.where(z > 0, -1.0, 1.0), 0.0)
    return np.clip(2 - size, 0, None) ** 3 / 6 - np.clip(1 - size, 0, None) ** 3 * 4 / 6


def spline_matrix(n: int, step: float, cutoff: float, left: str, right: str) -> np.ndarray:
    """The n nodes' products of splines, and of their third derivatives weighted by (cutoff / 2 pi)^6, by two Gauss points an interval."""
    weight, out = (cutoff / (2 * np.pi)) ** 6, np.zeros((n, n))
    first, end = min(CONDITIONS[left][0], 1), max(n - 1 - CONDITIONS[right][0], n - 2)
    for mu in (-1, 1):
        at = np.arange(first, end)[:, None] + 0.5 + 0.5 * np.sqrt(1 / 3) * mu - np.arange(n)[None, :]
        p, q = _basis(at, 0), _basis(at, 3) / step**3
        out += 0.5 * (p.T @ p + weight * q.T @ q)
    return out


@dataclass(frozen=True)
class SplineSystem:
    """The folded system of a line of nodes, factored."""

    fold: np.ndarray
    factor: np.ndarray
    shift: int  # from a node that stays to its place among all

    @staticmethod
    def of(n: int, step: float, cutoff: float, left: str = "R0", right: str = "R0") -> SplineSystem:
        g = folding(n, left, right)
        return SplineSystem(g, np.linalg.cholesky(g @ spline_matrix(n, step, cutoff, left, right) @ g.T), CONDITIONS[left][0])

    def dense(self) -> np.ndarray:
        """The whole transform as a matrix."""
        half = np.linalg.solve(self.factor, self.fold)
        return half.T @ half

    @property
    def periodic(self) -> bool:
        return bool(np.abs(np.tril(self.factor, -BAND - 1)).max(initial=0.0) > 0)

    def recurrences(self) -> tuple[Recurrence, Recurrence]:
        """The two triangular solves; the second counts places from the last."""
        f, m = self.factor, len(self.factor)
        gain = 1 / np.diag(f)
        down, up = np.zeros((m, BAND)), np.zeros((m, BAND))
        for k in range(1, BAND + 1):
            down[k:, k - 1] = -np.diag(f, -k) * gain[k:]
            up[:-k, k - 1] = -np.diag(f, -k) * gain[:-k]
        return Recurrence(gain, down), Recurrence(gain[::-1].copy(), up[::-1].copy())


def spline_transform(rows: DataFrame, keys: list[str], place: str, value: str, system: SplineSystem, block: int = BLOCK) -> DataFrame:
    """keys, place, value: the nodes' coefficients that solve the folded system for what lines hold at their nodes.

    A periodic line's factor is not banded: such a line is one block, and is
    multiplied with the whole transform.
    """
    g, shift = system.fold, system.shift
    m, n = g.shape
    if n <= block:
        cut, work = Cut(n, n), _whole_lines(system)
        return from_blocks(to_blocks(rows, keys, place, value, cut).withColumn("values", _mapped(work, "values")), keys, place, value, cut)
    if system.periodic:
        raise ValueError("a periodic line has to fit a block")
    # folding is a shift, and a few entries near both ends
    ends = [(int(r), int(c), float(g[r, c])) for r, c in zip(*np.nonzero(g), strict=True) if c - r != shift]
    entries = F.broadcast(rows.sparkSession.createDataFrame(ends or [(-1, -1, 0.0)], "row int, col int, weight double"))  # a few rows
    there = rows.select(*keys, F.col(place).cast("int").alias(place), F.coalesce(F.col(value).cast("double"), F.lit(0.0)).alias(value))

    def moved(source: DataFrame, by: int, at: str, to: str, size: int) -> DataFrame:
        own = source.select(*keys, (F.col(place) - by).alias(place), value).where(F.col(place).between(0, size - 1))
        added = source.join(entries, F.col(place) == F.col(at)).select(*keys, F.col(to).alias(place), (F.col("weight") * F.col(value)).alias(value))
        return own.unionByName(added)

    cut = Cut(m, block)
    down, up = system.recurrences()
    folded = moved(there, shift, "col", "row", m).groupBy(*keys, place).agg(F.sum(value).alias(value))
    solved = swept(swept(to_blocks(folded, keys, place, value, cut), keys, down, cut), keys, up, cut, backwards=True)
    back = moved(from_blocks(solved, keys, place, value, cut), -shift, "row", "col", n)
    gone = there.where((F.col(place) < shift) | (F.col(place) >= m + shift)).select(*keys, place, F.lit(0.0).alias(value))  # zero, but for what ends add
    return back.unionByName(gone).groupBy(*keys, place).agg(F.sum(value).alias(value))


def _whole_lines(system: SplineSystem):
    """The transform of lines that are there whole."""
    g, shift = system.fold, system.shift
    m, n = g.shape
    ends = [(r, c, g[r, c]) for r, c in zip(*np.nonzero(g), strict=True) if c - r != shift]
    whole = system.dense() if system.periodic else None
    down, up = system.recurrences()

    def work(values: pd.Series) -> pd.Series:
        out = []
        for at in range(0, len(values), max(1, CHUNK // n)):
            v = np.stack(list(values[at : at + max(1, CHUNK // n)]))
            if whole is not None:
                out += list(v @ whole.T)
                continue
            b = v[:, shift : shift + m].copy()
            for r, c, w in ends:
                b[:, r] += w * v[:, c]
            none = np.zeros((len(v), BAND))
            x = up.run(0, down.run(0, b, none)[:, ::-1], none)[:, ::-1]
            a = np.zeros_like(v)
            a[:, shift : shift + m] = x
            for r, c, w in ends:
                a[:, c] += w * x[:, r]
            out += list(a)
        return pd.Series(out)

    return work
