"""Blocks of the plane with bounded numbers of points: a tree of cuts, made from some of the points and followed by all."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame

#: Points that a block should hold, and blocks that a tree may have; beyond their product blocks grow.
POINTS, BLOCKS = 2048, 32768
#: Points of a block that its cuts are made from.
SAMPLED = 16


@dataclass(frozen=True)
class Blocks:
    """Nodes of a tree: the axis that a node is cut on (-1: it is a block), the place, the first of its two children, its box.

    What lies at a cut or beyond belongs to the second child.
    """

    axis: np.ndarray
    cut: np.ndarray
    child: np.ndarray
    low: np.ndarray
    high: np.ndarray

    def holding(self, xy: np.ndarray) -> np.ndarray:
        """The block of each place."""
        node = np.zeros(len(xy), np.int32)
        below = np.arange(len(xy))
        while len(below := below[self.axis[node[below]] >= 0]):
            at = node[below]
            node[below] = self.child[at] + (xy[below, self.axis[at]] >= self.cut[at])
        return node

    def within(self, xy: np.ndarray, bound: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Every place and block no farther apart than the place's bound, as indices of both.

        A box is measured as a point is, so that rounding never puts it farther than a point in it.
        """
        who, node = np.arange(len(xy)), np.zeros(len(xy), np.int32)
        told = []
        while len(who):
            ends = self.axis[node] < 0
            told.append((who[ends], node[ends]))
            who, at = np.tile(who[~ends], 2), node[~ends]
            node = np.concatenate([self.child[at], self.child[at] + 1])
            gap = np.maximum(np.maximum(self.low[node] - xy[who], xy[who] - self.high[node]), 0.0)
            near = apart(gap[:, 0], gap[:, 1]) <= bound[who]
            who, node = who[near], node[near]
        return tuple(np.concatenate(part) for part in zip(*told, strict=True)) if told else (who, node)


def apart(dx: np.ndarray, dy: np.ndarray) -> np.ndarray:
    """The root of the sum of squares, rounded as SQL's: hypot says that equal distances differ."""
    with np.errstate(over="ignore"):
        return np.sqrt(dx * dx + dy * dy)


def cut(sample: np.ndarray, most: int) -> Blocks:
    """Halves the sample on its longer side until no part holds more than most; places that coincide stay together."""
    axis, cuts, child, low, high = [-1], [0.0], [0], [[-np.inf] * 2], [[np.inf] * 2]
    todo = [(0, sample)]
    while todo:
        node, xy = todo.pop()
        if len(xy) <= most:
            continue
        sides = xy.max(axis=0) - xy.min(axis=0)
        a = int(np.argmax(sides))
        if not sides[a] > 0:
            continue
        v = xy[:, a]
        at = np.partition(v, len(v) // 2)[len(v) // 2]
        if at == v.min():
            at = v[v > at].min()
        axis[node], cuts[node], child[node] = a, at, len(axis)
        for part in (xy[v < at], xy[v >= at]):
            todo.append((len(axis), part))
            axis.append(-1), cuts.append(0.0), child.append(0), low.append(list(low[node])), high.append(list(high[node]))
        high[-2][a] = low[-1][a] = at
    return Blocks(np.array(axis, np.int8), np.array(cuts), np.array(child, np.int32), np.array(low), np.array(high))


def fitted(points: DataFrame, x: str, y: str, size: int) -> Blocks:
    """Blocks of some size points each. Only what the cuts are made from reaches the driver: 16 places a block, half a million at most."""
    n = points.count()
    if n <= size:
        return cut(np.empty((0, 2)), SAMPLED)
    told = points.select(x, y).sample(min(1.0, SAMPLED * min(1 / size, BLOCKS / n)), seed=1).toArrow()
    return cut(np.column_stack([told[c].to_numpy() for c in (x, y)]), SAMPLED)
