"""Connected components by alternating large-star and small-star steps.

The link list never leaves the executors.  Each round is written to the shared
folder, and links are kept as (a, b) with a > b.  See Kiveris et al.,
"Connected Components in MapReduce and Beyond", 2014.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import Scratch, partitions


def connected_components(links: DataFrame, left: str, right: str, scratch: Scratch, max_rounds: int = 60) -> DataFrame:
    """node, component for every node with a link to another; component is the smallest reachable node."""
    spark = links.sparkSession
    n = partitions(spark)
    edges = links.select(F.greatest(left, right).alias("a"), F.least(left, right).alias("b")).where("a > b").distinct()
    edges = scratch.table(edges, "links")
    mark = _mark(edges)
    for _ in range(max_rounds):
        if mark[0] == 0:
            break
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select("b", "a"))
        # dealt anew: a join of two plain exchanges, whose hot keys AQE can split
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")).repartition(n)
        large = edges.join(least, edges.b == least.u).select("a", F.col("m").alias("b")).distinct()
        large = scratch.table(large, "large-star")
        least = large.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("m")).repartition(n)
        pairs = large.join(least, large.a == least.u)
        small = pairs.select("b", "m").where("b > m").toDF("a", "b").union(least.select("u", "m"))
        edges = scratch.table(small.distinct(), "small-star")
        last, mark = mark, _mark(edges)
        if mark == last:
            break
    else:
        raise RuntimeError("components did not settle")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).union(
        edges.select("b", "b").distinct().toDF("node", "component")
    )


def _mark(edges: DataFrame) -> tuple[int, int | None, int | None]:
    """What tells two lists of links apart, in one row that no number of links can overflow."""
    row = edges.agg(F.count("*").alias("n"), *[F.bit_xor(F.xxhash64(F.lit(k), "a", "b")).alias(f"x{k}") for k in (1, 2)]).first()
    return row.n, row.x1, row.x2
