"""Near-deduplication of embeddings with a forest of random-projection trees.

Each tree splits the vectors again and again by a random direction; vectors
whose projection lies within ``spill`` of the threshold go to both sides.  The
driver fits the upper part of every tree, down to groups of some GROUP_ROWS
vectors, from a sample of about ``sample_rows``; a task fits the rest of a
group's tree from all vectors of the group.  Within a leaf all pairs are
verified in double precision.  A pair that meets in several leaves counts in
the first of them only, so link counts are exact for the pairs found, and
groups return counts and forests of links, never the pairs.

Vectors travel once for each group, not for each leaf, and large tables are
taken some trees at a time; a task holds one group, and cuts of it where the
sample found a group that no direction splits.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import FloatType

from .cells import by_keys, forest, in_cells
from .components import connected_components
from .storage import Scratch, new_path, partitions, release_shuffles, scratched, write_and_read

#: Rows of a leaf that are compared with one another at once.
CELL_ROWS = 1024
#: Vectors of a group, as the driver's sample tells; beyond twice as many it is cut into cells.
GROUP_ROWS = 4096
#: Copies of vectors that a task gets, and that one pass over some of the trees moves, if it can be helped.
TASK_ROWS, PASS_ROWS = 100_000, 4_000_000
#: A path in a tree: the tree in the top bits, then a 1, then a bit for each split.
DEPTH = 48
TREE_BITS = DEPTH + 2
#: Leaves that are looked at together for pairs that have met before.
MET = 2048


def usable(vector: Column) -> Column:
    """Neither null nor zero, and no component null, NaN or infinite."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def unit_rows(blobs: Sequence[bytes], kind: str) -> np.ndarray:
    """Vectors of one length, whose components are of a kind, as unit rows in double precision."""
    x = np.frombuffer(b"".join(blobs), kind).reshape(len(blobs), -1).astype(float)
    x /= np.abs(x).max(axis=1, keepdims=True)  # so that squares neither overflow nor vanish
    x /= np.sqrt((x * x).sum(axis=1, keepdims=True))
    return x


#: What ends a path.
DONE = 1


class Open:
    """Ends a path of the driver's part of a tree: a task goes on with the seed."""

    __slots__ = ("seed",)

    def __init__(self, seed: int):
        self.seed = seed


class Split:
    __slots__ = ("seed", "at", "left", "right")

    def __init__(self, seed: int, at: float, left: Split | Open | int, right: Split | Open | int):
        self.seed, self.at, self.left, self.right = seed, at, left, right


def direction(seed: int, dim: int) -> np.ndarray:
    r = np.random.default_rng(seed).standard_normal(dim)
    return r / np.sqrt(r @ r)


def grow(x: np.ndarray, scale: float, leaf_rows: int, spill: float, seed: int, depth: int, group_rows: int = 0) -> Split | Open | int:
    """A tree over unit rows, each of which stands for scale vectors; left open at groups of group_rows."""
    n = len(x)
    if n * scale <= leaf_rows or depth >= DEPTH:
        return DONE
    if group_rows and (n * scale <= group_rows or n < 48):
        return Open(seed)
    if n < 48:
        return DONE
    best = None
    for k in range(3):
        s = (seed * 1_000_003 + 7919 * k + 1) % (1 << 62)
        p = x @ direction(s, x.shape[1])
        for at in np.quantile(p, (0.5, 0.4, 0.6, 0.25, 0.75)):
            left, right = int((p <= at + spill).sum()), int((p > at - spill).sum())
            cost = max(left, right) + 2.0 * (left + right - n)
            if best is None or cost < best[0]:
                best = (cost, s, float(at), p, left, right)
    _, s, at, p, left, right = best
    if max(left, right) > 0.9 * n:
        return DONE  # as good as one tight group: compared whole, in cells
    return Split(
        s, at,
        grow(x[p <= at + spill], scale, leaf_rows, spill, s + 1, depth + 1, group_rows),
        grow(x[p > at - spill], scale, leaf_rows, spill, s + 2, depth + 1, group_rows),
    )


def route(tree: Split | Open | int, x: np.ndarray, rows: np.ndarray, path: int, spill: float, out: list[tuple[np.ndarray, int, Open | int]]) -> None:
    """Appends (rows, path, DONE or Open) for every end that rows reach."""
    if not len(rows):
        return
    if not isinstance(tree, Split):
        out.append((rows, path, tree))
        return
    p = x[rows] @ direction(tree.seed, x.shape[1])
    route(tree.left, x, rows[p <= tree.at + spill], 2 * path, spill, out)
    route(tree.right, x, rows[p > tree.at - spill], 2 * path + 1, spill, out)


def lists(owner: np.ndarray, values: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The values of n owners, one owner after another, and where each owner's start, and their end."""
    order = np.argsort(owner, kind="stable")
    return values[order], np.append(0, np.cumsum(np.bincount(owner, minlength=n)))


def packed(values: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """Lists of longs as binary."""
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(bounds) - 1, [None, pa.py_buffer(8 * bounds.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(values))]).cast(pa.binary())


ROUTED = "item long, node long, mult long, dim int, vec binary, units array<long>, seeds array<long>, done binary"


def upper_trees(vectors: DataFrame, kind: str, trees: int, leaf_rows: int, spill: float, sample_rows: int, seed: int) -> DataFrame:
    """vectors (item, node, mult, dim, vec) with their units: groups with the seed that splits them on, or leaves (-1), which done has packed, too."""
    total = vectors.count()
    sample = vectors.select("dim", "vec")
    if total > sample_rows:  # about sample_rows, by a hash
        sample = sample.where(F.xxhash64("vec") < F.lit(int(-(2**63) + 2**64 * (sample_rows / total))))
    sample = sample.toArrow().to_pandas()
    scale = max(1.0, total / max(1, len(sample)))

    def start(tree: int, dim: int) -> int:
        return seed + (((tree << TREE_BITS) | 1) * 31 + 8 * dim) % (1 << 40)

    model = {}
    for dim, own in sample.groupby("dim"):
        x = unit_rows(own["vec"], kind)
        for tree in range(trees):
            model[(int(dim), tree)] = grow(x, scale, leaf_rows, spill, start(tree, int(dim)), 0, GROUP_ROWS)

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            dims = batch.column("dim").to_numpy()
            owner, unit, then = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for dim in np.unique(dims).tolist():
                own = np.flatnonzero(dims == dim)
                x = unit_rows(batch.column("vec").take(pa.array(own)).to_pylist(), kind)
                for tree in range(trees):
                    found: list = []
                    route(model.get((dim, tree)) or Open(start(tree, dim)), x, np.arange(len(own)), 1, spill, found)
                    for rows, path, end in found:
                        owner.append(own[rows])
                        unit.append(np.full(len(rows), (tree << TREE_BITS) | path))
                        then.append(np.full(len(rows), end.seed if isinstance(end, Open) else -1))
            owner, unit, then = map(np.concatenate, (owner, unit, then))
            units, bounds = lists(owner, unit, n)
            seeds, _ = lists(owner, then, n)
            done = then < 0
            places = pa.array(bounds, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.ListArray.from_arrays(places, pa.array(units)), pa.ListArray.from_arrays(places, pa.array(seeds)), packed(*lists(owner[done], unit[done], n))],
                names=[*batch.schema.names, "units", "seeds", "done"],
            )

    return vectors.select("item", "node", "mult", "dim", "vec").mapInArrow(step, ROUTED)


def lower_tree(group: pd.DataFrame, kind: str, leaf_rows: int, spill: float) -> pd.DataFrame:
    """Of one group: (item, leaves) with the packed leaves of its tree that each vector lies in."""
    unit = int(group["unit"].iloc[0])
    path = unit & ((1 << TREE_BITS) - 1)
    x = unit_rows(group["vec"], kind)
    tree = grow(x, 1.0, leaf_rows, spill, int(group["seed"].iloc[0]), path.bit_length() - 1)
    found: list = []
    route(tree, x, np.arange(len(x)), path, spill, found)
    values, bounds = lists(np.concatenate([f[0] for f in found]), np.concatenate([np.full(len(f[0]), unit - path + f[1]) for f in found]), len(x))
    return pd.DataFrame({"item": group["item"].to_numpy(), "leaves": packed(values, bounds).to_pylist()})


def below(leaves: np.ndarray, unit: int) -> np.ndarray:
    """Whether each leaf is the unit itself or a part of it."""
    mask = (1 << TREE_BITS) - 1
    path = leaves & mask
    shift = np.frexp(path.astype(float))[1] - (unit & mask).bit_length()
    return (leaves >> TREE_BITS == unit >> TREE_BITS) & (shift >= 0) & (path >> np.maximum(shift, 0) == unit & mask)


def apart_before(near: np.ndarray, left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Of near pairs (rows, columns): those whose leaf lists have nothing in common."""
    ids, at = np.unique(np.concatenate([*left, *right]), return_inverse=True)
    owner = np.repeat(np.arange(len(left) + len(right)), [len(v) for v in (*left, *right)])
    first = owner < len(left)
    both = np.flatnonzero((np.bincount(at[first], minlength=len(ids)) > 0) & (np.bincount(at[~first], minlength=len(ids)) > 0))
    place = np.full(len(ids), -1)
    place[both] = np.arange(len(both))
    at = place[at]
    for low in range(0, len(both), MET):
        some = (at >= low) & (at < low + MET)
        member = np.zeros((len(left) + len(right), min(MET, len(both) - low)), np.float32)
        member[owner[some], at[some] - low] = 1
        near = near & (member[: len(left)] @ member[len(left) :].T == 0)
    return near


def links_in(cell: pd.DataFrame, threshold: float, kind: str, cell_rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of one cell: the rows that have links, how many, and a forest of the links (a, b), all by position."""
    mult, chunk, unit = cell["mult"].to_numpy(), cell["chunk"].to_numpy(), int(cell["unit"].iloc[0])
    cut = cell["lo"].iloc[0] != cell["hi"].iloc[0]  # then pairs of one chunk count elsewhere, even if the other chunk is empty
    x = unit_rows(cell["vec"], kind)
    bounds = np.append(0, np.cumsum(cell["leaves"].map(len).to_numpy() // 8))
    flat = np.frombuffer(b"".join(cell["leaves"]), np.int64)
    here = np.flatnonzero(below(flat, unit))
    here = here[np.argsort(flat[here], kind="stable")]
    owner = np.searchsorted(bounds, here, side="right") - 1
    ends = np.append(np.flatnonzero(np.diff(flat[here])) + 1, len(here))
    counts = np.zeros(len(cell), np.int64)
    a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for start, end in zip(np.append(0, ends[:-1]).tolist(), ends.tolist(), strict=True):
        leaf, members = flat[here[start]], owner[start:end]
        for i in range(0, len(members), cell_rows):
            for j in range(i, len(members), cell_rows):
                p, q = members[i : i + cell_rows], members[j : j + cell_rows]
                near = x[p] @ x[q].T >= threshold
                if i == j:
                    near = np.triu(near, 1)
                if cut:
                    near &= chunk[p][:, None] != chunk[q][None, :]
                rows, columns = np.flatnonzero(near.any(axis=1)), np.flatnonzero(near.any(axis=0))
                if not len(rows):
                    continue
                p, q, near = p[rows], q[columns], near[np.ix_(rows, columns)]
                # leaves before this one that hold both ends: there the pair has counted already
                before = [[v[v < leaf] for v in (flat[bounds[r] : bounds[r + 1]] for r in side)] for side in (p, q)]
                near = apart_before(near, *before)
                np.add.at(counts, p, near @ mult[q])
                np.add.at(counts, q, near.T @ mult[p])
                k, m = np.nonzero(near)
                ids, at = np.unique(np.concatenate([p, q]), return_inverse=True)
                root = forest(len(ids), at[k], at[len(p) + m])
                told = np.flatnonzero(root != np.arange(len(ids)))
                a.append(ids[told])
                b.append(ids[root[told]])
    root = forest(len(cell), np.concatenate(a), np.concatenate(b))
    told = np.flatnonzero(root != np.arange(len(cell)))
    hit = np.flatnonzero(counts)
    return hit, counts[hit], told, root[told]


def passes(rows: dict[int, int]) -> list[tuple[int, int, int]]:
    """Ranges of trees (first, last, rows) that one pass takes, by the rows of each tree."""
    out: list[tuple[int, int, int]] = []
    for tree, n in sorted(rows.items()):
        if out and out[-1][2] + n <= PASS_ROWS:
            out[-1] = (out[-1][0], tree, out[-1][2] + n)
        else:
            out.append((tree, tree, n))
    return out


@scratched
def embedding_dedup(
    scratch: Scratch, vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = 0.95,
    trees: int = 6, leaf_rows: int = 256, spill: float = 0.025, sample_rows: int = 20_000, seed: int = 17,
) -> DataFrame:
    """One row for each row of vectors: vec_id, n_links, component_id, kept.

    n_links counts the other rows whose cosine, in double precision, is at
    least threshold; component_id is the smallest vec_id that links reach, its
    own included.  Vectors that are null, empty, zero or hold null or
    non-finite components link with nothing, as do rows without vec_id and
    vectors of different lengths.  Equal vectors are compared once and link
    with each other; rows that share a vec_id are one node of the components.
    A cosine of exactly the threshold links.  An empty table gives an empty one.
    The forest is approximate: the README has its measured recall.
    """
    spark = vectors.sparkSession
    single = isinstance(vectors.select(vector_col).schema[0].dataType.elementType, FloatType)
    number, kind = ("float", "<f4") if single else ("double", "<f8")
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast(f"array<{number}>").alias("v"))
    good = usable(F.col("v")) & F.col("vec_id").isNotNull()
    # -0.0 + 0.0 is 0.0: vectors that are equal as numbers are equal as bytes
    rows = rows.select("vec_id", F.when(good, F.transform("v", lambda x: x + F.lit(0.0).cast(number))).alias("v"))

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            batch["vec"] = [None if v is None else np.asarray(v, kind).tobytes() for v in batch["v"]]
            yield batch[["vec_id", "vec"]]

    rows = scratch.table(rows.mapInPandas(pack, "vec_id long, vec binary"), "vectors")
    found = rows.where("vec IS NOT NULL")
    distinct = found.groupBy("vec").agg(F.min("vec_id").alias("node"), F.count("*").alias("mult"))
    dim = (F.length("vec") / np.dtype(kind).itemsize).cast("int").alias("dim")
    distinct = scratch.table(distinct.select(F.monotonically_increasing_id().alias("item"), "node", "mult", dim, "vec"), "distinct")
    # dealt anew: the files of a small table are few, and a task routes its rows through all trees
    spread = distinct.repartition(partitions(spark))
    routed = scratch.table(upper_trees(spread, kind, trees, leaf_rows, spill, sample_rows, seed), "routed")
    sizes = scratch.table(routed.select("dim", F.explode("units").alias("unit")).groupBy("dim", "unit").agg(F.count("*").alias("group_rows")), "sizes")
    turns = passes({r.tree: r.n for r in sizes.groupBy(F.shiftright("unit", TREE_BITS).alias("tree")).agg(F.sum("group_rows").alias("n")).collect()})
    # groups that a task does not take whole; as each has many rows, they are few
    large = F.broadcast(sizes.where(F.col("group_rows") > 2 * GROUP_ROWS))

    def copies(table: DataFrame, first: int, last: int, *columns: str) -> DataFrame:
        """A row for each vector and unit of some trees."""
        units = F.filter(F.arrays_zip("units", "seeds"), lambda u: F.shiftright(u["units"], TREE_BITS).between(first, last))
        return table.select("item", "dim", "vec", *columns, F.explode(units).alias("u")).select("item", "dim", "vec", *columns, F.col("u.units").alias("unit"), F.col("u.seeds").alias("seed"))

    def tasks(n: int) -> int:
        return max(partitions(spark), n // TASK_ROWS)

    def fit(groups: list[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for group in groups:
            yield lower_tree(group, kind, leaf_rows, spill)

    lower = []
    for first, last, n in turns:
        groups = copies(routed, first, last).where("seed >= 0")
        lower.append(scratch.table(by_keys(groups, ["unit", "dim"], fit, "item long, leaves binary", tasks(n)), "lower"))
        release_shuffles(spark)

    def work(groups: list[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for cell in groups:
            hit, counts, a, b = links_in(cell, threshold, kind, CELL_ROWS)
            if len(hit):
                item, node = cell["item"].to_numpy(), cell["node"].to_numpy()
                yield pd.DataFrame({"item": item[hit], "n": counts, "a": node[hit], "b": node[hit]})
                yield pd.DataFrame({"item": item[a], "n": 0, "a": node[a], "b": node[b]})

    told = []
    if lower:
        leaves = reduce(DataFrame.unionByName, lower).groupBy("item").agg(F.collect_list("leaves").alias("parts"))
        leaves = leaves.select("item", F.aggregate("parts", F.lit(b""), lambda x, y: F.concat(x, y)).alias("lower"))
        planted = routed.join(leaves, "item", "left").withColumn("leaves", F.concat("done", F.coalesce("lower", F.lit(b"")))).drop("done", "lower")
        planted = scratch.table(planted, "planted")
        scratch.drop("lower")
        scratch.drop("routed")
        release_shuffles(spark)
    for first, last, n in turns:
        cells = copies(planted, first, last, "node", "mult", "leaves").drop("seed").join(large, ["dim", "unit"], "left")
        cells = in_cells(cells.withColumn("group_rows", F.coalesce("group_rows", F.lit(1))), "item", 2 * GROUP_ROWS)
        told.append(scratch.table(by_keys(cells, ["unit", "dim", "lo", "hi"], work, "item long, n long, a long, b long", tasks(n)), "links"))
        release_shuffles(spark)
    told = reduce(DataFrame.unionByName, told) if told else spark.createDataFrame([], "item long, n long, a long, b long")
    counts = told.groupBy("item").agg(F.sum("n").alias("n"))
    parts = connected_components(told.where("a <> b"), "a", "b", scratch)
    # equal vectors whose rows have several ids join what their smallest id joins
    own = distinct.join(counts, "item", "left")
    own = own.join(parts.withColumnRenamed("node", "other"), F.col("node") == F.col("other"), "left")
    own = own.select("vec", (F.coalesce("n", F.lit(0)) + F.col("mult") - 1).alias("n_links"), F.coalesce("component", "node").alias("component_id"))
    own = scratch.table(own, "groups")
    linked = found.join(own, "vec").select("vec_id", "n_links", "component_id")
    alone = rows.where("vec IS NULL").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    out = linked.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
    return write_and_read(out, new_path(spark, "embeddings"))
