"""Pairwise work within groups of any size, dealt out as cells of bounded size.

A group with more than ``limit`` rows is cut into chunks by a hash of the row
id; the cell (i, j) holds the chunks i <= j, so that every pair of rows meets
in exactly the cells of their two chunks, and no task gets an unbounded group.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import partitions


def pair_cells(rows: DataFrame, key: str, item: str, limit: int) -> DataFrame:
    """Rows of groups of two and more, with lo, hi (the cell) and chunk (the row's own)."""
    n = partitions(rows.sparkSession)
    sizes = rows.groupBy(key).agg(F.count("*").alias("group_rows")).where("group_rows > 1")
    # dealt anew, so that both sides of the join are plain exchanges: AQE can then split a hot group
    return in_cells(rows.join(sizes.repartition(n), key), item, limit)


def in_cells(rows: DataFrame, item: str, limit: int) -> DataFrame:
    """Rows whose group_rows is known, once for each of their cells: lo, hi (the cell) and chunk (the row's own)."""
    chunks = F.ceil(F.col("group_rows") / F.lit(limit)).cast("int")
    dealt = rows.withColumn("chunks", chunks).drop("group_rows")
    dealt = dealt.withColumn("chunk", F.pmod(F.xxhash64(F.col(item)), F.col("chunks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    return dealt.withColumns({"lo": F.least("chunk", "other"), "hi": F.greatest("chunk", "other")}).drop("other", "chunks")


def by_cell(cells: DataFrame, key: str, work: Callable[[list[pd.DataFrame]], Iterator[pd.DataFrame]], schema: str) -> DataFrame:
    """Runs work over lists of whole cells; a list holds many small cells or one large one."""
    return by_keys(cells, [key, "lo", "hi"], work, schema, partitions(cells.sparkSession))


def by_keys(rows: DataFrame, keys: list[str], work: Callable[[list[pd.DataFrame]], Iterator[pd.DataFrame]], schema: str, n: int) -> DataFrame:
    """Runs work over lists of whole groups of equal keys, in n tasks."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for groups in whole_runs(batches, keys):
            yield from work(groups)

    return rows.repartition(n, *keys).sortWithinPartitions(*keys).mapInPandas(run, schema)


def whole_runs(batches: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[list[pd.DataFrame]]:
    """Cuts sorted batches into runs of equal keys; yields the complete runs of each batch."""
    rest: list[pd.DataFrame] = []
    for batch in batches:
        if not len(batch):
            continue
        if rest and all(rest[-1][k].iloc[-1] == batch[k].iloc[0] for k in keys) and all(batch[k].iloc[0] == batch[k].iloc[-1] for k in keys):
            rest.append(batch)
            continue
        frame = pd.concat([*rest, batch], ignore_index=True) if rest else batch
        new = np.ones(len(frame), bool)
        new[1:] = np.logical_or.reduce([frame[k].to_numpy()[1:] != frame[k].to_numpy()[:-1] for k in keys])
        starts = np.flatnonzero(new)
        if len(starts) > 1:
            yield [frame.iloc[a:b] for a, b in zip(starts[:-1], starts[1:], strict=True)]
        rest = [frame.iloc[starts[-1] :]]
    if rest:
        yield [pd.concat(rest, ignore_index=True)]


def forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For n nodes and the links (a, b): the smallest node that each can reach."""
    root = np.arange(n)
    while len(a):
        ra, rb = root[a], root[b]
        apart = ra != rb
        if not apart.any():
            break
        a, b = a[apart], b[apart]
        np.minimum.at(root, np.maximum(ra, rb)[apart], np.minimum(ra, rb)[apart])
        while (root[root] != root).any():
            root = root[root]
    return root
