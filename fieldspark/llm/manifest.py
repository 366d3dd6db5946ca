"""A Merkle manifest of a data set: one ternary tree for each group, and one over the groups' roots.

Leaves are sorted by range into a checkpointed RDD, whose partitions stay what
they are however often they are read.  Each partition tells how many leaves
its first and last groups have in it, one row a partition; from these follow
the places of all leaves in their groups.  A partition then builds every
subtree whose leaves it holds whole, and hands on only the tops of these, a
few for each level at either end.  The tops meet by coordinate (group, level,
index), LEVELS levels a round, until each group has its root.  Proofs come
back the same way: that of a leaf is its path below the top, then the top's.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator
from itertools import groupby

from pyspark import RDD
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from .storage import Scratch, new_path, partitions, scratched, shared_dir, small_side, write_and_read

ARITY = 3
#: Levels that are finished in one round: a key gets at most ARITY ** LEVELS nodes a level.
LEVELS = 4
#: Leaves of a group that a partition works on at once: ARITY ** BLOCK.
BLOCK = 6
PROOF = "array<struct<left: binary, right: binary>>"
Path = list[tuple[bytes, bytes]]


def digest(*parts: str) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def described(values: list[Column]) -> Column:
    """The leaf of a row: the hash of its values, '-' for null, otherwise byte count, ':' and value."""
    told = []
    for value in values:
        text = value.cast("string")
        told.append(F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-")))
    return F.sha2(F.concat(*told).cast("binary"), 256)


def height(n: int) -> int:
    """Levels above the leaves of a tree of n leaves."""
    levels = 0
    while n > 1:
        n, levels = -(-n // ARITY), levels + 1
    return levels


def climb(nodes: dict[tuple[int, int], str], n: int, top: int) -> tuple[dict[tuple[int, int], str], dict[tuple[int, int], tuple[tuple[int, int], Path]]]:
    """Builds all nodes up to a level whose children are there; nodes are (level, index) of a tree of n leaves.

    Returns the nodes that no parent was built for, and of each node given
    the one of these that it lies under, with the path of siblings up to it.
    """
    by_level = defaultdict(dict)
    for (level, j), node in nodes.items():
        by_level[level][j] = node
    path = {at: (at, []) for at in nodes}
    under = {at: [at] for at in nodes}
    open_nodes, top = {}, min(top, height(n))
    for level in range(min(by_level, default=0), top):
        width = -(-n // ARITY**level)
        here, runs = by_level[level], defaultdict(list)
        for j in here:
            runs[j // ARITY].append(j)
        for run, found in runs.items():
            first, last = run * ARITY, min(run * ARITY + ARITY, width)
            if len(found) < last - first:
                open_nodes |= {(level, j): here[j] for j in found}
                continue
            parts = [here[j] for j in range(first, last)]
            by_level[level + 1][run] = digest(*parts)
            under[level + 1, run] = []
            for k, j in enumerate(range(first, last)):
                step = (bytes.fromhex("".join(parts[:k])), bytes.fromhex("".join(parts[k + 1 :])))
                for at in under.pop((level, j), ()):
                    path[at] = ((level + 1, run), [*path[at][1], step])
                    under[level + 1, run].append(at)
    open_nodes |= {(top, j): node for j, node in by_level[top].items()}
    open_nodes |= {(level, j): node for level in by_level if level > top for j, node in by_level[level].items()}
    return open_nodes, path


def _checkpointed(rdd: RDD) -> RDD:
    """Its partitions as files below the shared folder: what a lost executor had is read again, and stays the same."""
    context = rdd.context
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(shared_dir(SparkSession.active()))
    rdd.checkpoint()
    return rdd


def _ends(index: int, rows: Iterator[Row]) -> Iterator[tuple]:
    """One row for a partition: its index, first group and its rows, last group and its rows."""
    first = last = None
    for key, found in groupby(rows, key=lambda r: r["group"]):
        last = (key, sum(1 for _ in found))
        first = first or last
    if first:
        yield index, first, last


def offsets(ends: list[tuple]) -> dict[int, tuple[int, int, int]]:
    """For each partition: leaves of its first group before it, and after it, and leaves of its last group after it.

    Takes a row for each partition; groups that lie within one need no entry.
    """
    before, total = {}, defaultdict(int)
    for index, first, last in ends:
        before[index] = total[first[0]]
        total[first[0]] += first[1]
        if last[0] != first[0]:
            total[last[0]] += last[1]
    reached, out = defaultdict(int), {}
    for index, first, last in ends:
        reached[first[0]] += first[1]
        if last[0] != first[0]:
            reached[last[0]] += last[1]
        out[index] = before[index], total[first[0]] - reached[first[0]], total[last[0]] - reached[last[0]]
    return out


def _local(key: str | None, start: int, size: int, digests: bytearray, kept: list) -> Iterator[tuple]:
    """The tops and then the leaves of one group in a partition; its leaves begin at start, and the group has size of them.

    Blocks of leaves are built, what is left of them is built further, and
    then each block again for its paths: memory holds 32 bytes a leaf and the paths of one block.
    """
    wide, end = ARITY**BLOCK, start + len(kept)
    cuts = sorted({start, end, *range(-(-start // wide) * wide, end, wide)})

    def block(a: int, b: int):
        raw = digests[32 * (a - start) : 32 * (b - start)]
        return climb({(0, a + k): raw[32 * k : 32 * k + 32].hex() for k in range(b - a)}, size, BLOCK)

    middle = {}
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        middle |= block(a, b)[0]
    tops, above = climb(middle, size, height(size))
    for (level, j), node in tops.items():
        if level < height(size):
            yield None, key, level, j, size, node, []
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        _, path = block(a, b)
        for j in range(a, b):
            at, steps = path[0, j]
            top, further = above[at]
            yield kept[j - start], key, *top, size, tops[top], [*steps, *further]


def built(scratch: Scratch, leaves: DataFrame, order: list[str]) -> tuple[DataFrame, DataFrame]:
    """Trees over leaves (group, node, kept, and the columns of order), ascending by order within their group.

    group sorts bytewise, null first and a group of its own.  Returns the
    leaves (kept, group, level, place, node, proof) with the top that they lie
    under and the path of siblings up to it, nearest first; and of the tops
    that are not their group's root: on_group, on_level, on_place, with root
    and rest, the path from there.
    """
    spark, n = leaves.sparkSession, partitions(leaves.sparkSession)
    by = [F.col("group").asc_nulls_first(), *[F.col(c).asc_nulls_first() for c in order], F.col("node")]
    ranged = leaves.repartitionByRange(n, *by).sortWithinPartitions(*by)
    rows = _checkpointed(ranged.select("group", "node", "kept").rdd)
    ends = sorted(rows.mapPartitionsWithIndex(_ends).collect(), key=lambda e: e[0])  # a row for each partition
    placed = spark.sparkContext.broadcast(offsets(ends))

    def build(index: int, found: Iterator[Row]) -> Iterator[tuple]:
        before, after_first, after_last = placed.value.get(index, (0, 0, 0))
        first, waiting = True, None
        for key, own in groupby(found, key=lambda r: r["group"]):
            if waiting:
                yield from _local(*waiting)
            digests, kept = bytearray(), []
            for r in own:
                digests += bytes.fromhex(r["node"])
                kept.append(r["kept"])
            start = before if first else 0
            waiting = (key, start, start + len(kept) + (after_first if first else 0), digests, kept)
            alone, first = first, False
        if waiting:
            key, start, size, digests, kept = waiting
            yield from _local(key, start, size if alone else size + after_last, digests, kept)

    kind = leaves.schema["kept"].dataType.simpleString()
    schema = f"kept {kind}, group string, level int, place long, size long, node string, proof {PROOF}"
    told = scratch.table(spark.createDataFrame(rows.mapPartitionsWithIndex(build), schema, verifySchema=False), "subtrees")
    return told.where("kept IS NOT NULL"), _finish(scratch, told.where("kept IS NULL").drop("kept", "proof"))


def _finish(scratch: Scratch, tops: DataFrame) -> DataFrame:
    """on_group, on_level, on_place, root, rest of each top (group, level, place, size, node), by rounds of LEVELS levels."""
    spark = tops.sparkSession
    n = partitions(spark)
    tall, rounds, waiting = tops.agg(F.max("size")).first()[0] or 0, [], tops
    for upto in range(LEVELS, height(tall) + LEVELS, LEVELS):

        def meet(item: tuple, upto: int = upto) -> Iterator[tuple]:
            found = list(item[1])
            size = found[0]["size"]
            nodes = {(r["level"], r["place"]): r["node"] for r in found}
            above, path = climb(nodes, size, upto)
            for at in nodes:
                to, steps = path[at]
                yield item[0][0], *at, *to, size, above[to], to[0] == height(size), steps

        block = F.floor(F.col("place") / F.pow(F.lit(float(ARITY)), F.lit(upto) - F.col("level"))).cast("long")
        here = waiting.where(F.col("level") < upto).withColumn("block", block)
        met = here.rdd.map(lambda r: ((r["group"], r["block"]), r)).groupByKey(n).flatMap(meet)
        schema = f"on_group string, on_level int, on_place long, level int, place long, size long, node string, ended boolean, proof {PROOF}"
        met = scratch.table(spark.createDataFrame(met, schema, verifySchema=False), "round")
        rounds.append(met)
        reached = met.where("NOT ended").select(F.col("on_group").alias("group"), "level", "place", "size", "node").distinct()
        waiting = scratch.table(reached.unionByName(waiting.where(F.col("level") >= upto)), "waiting")
    # downwards: a node's path is its own to where it has got, then that one's
    done = spark.createDataFrame([], f"on_group string, on_level int, on_place long, root string, rest {PROOF}")
    for met in reversed(rounds):
        up = done.toDF("up_group", "up_level", "up_place", "root", "rest")
        at = F.col("on_group").eqNullSafe(F.col("up_group")) & (F.col("level") == F.col("up_level")) & (F.col("place") == F.col("up_place"))
        lower = met.join(up, at, "left").select("on_group", "on_level", "on_place", F.coalesce("root", "node").alias("root"), _joined("proof", "rest").alias("rest"))
        done = scratch.table(lower.unionByName(done), "paths")
    return done


def _joined(proof: str, rest: str) -> Column:
    return F.concat(proof, F.coalesce(rest, F.array().cast(PROOF)))


def trees(scratch: Scratch, leaves: DataFrame, order: list[str]) -> DataFrame:
    """kept, group, root, proof of each row of leaves: its group's root and the path to it."""
    below, tops = built(scratch, leaves, order)
    at = F.col("group").eqNullSafe(F.col("on_group")) & (F.col("level") == F.col("on_level")) & (F.col("place") == F.col("on_place"))
    # leaves of groups that one partition holds have come to their root
    return below.join(small_side(tops), at, "left").select("kept", "group", F.coalesce("root", "node").alias("root"), _joined("proof", "rest").alias("proof"))


def _hex(raw: Column) -> Column:
    return F.lower(F.hex(raw))


def folded(leaf: Column, proof: Column) -> Column:
    """The root that a leaf and a path of siblings give."""
    return F.aggregate(proof, leaf, lambda node, step: F.sha2(F.concat(_hex(step["left"]), node, _hex(step["right"])).cast("binary"), 256))


def proof_digest(proof: Column) -> Column:
    """The hash of all siblings of a path, level by level, left to right."""
    return F.sha2(F.array_join(F.transform(proof, lambda step: _hex(F.concat(step["left"], step["right"]))), "").cast("binary"), 256)


@scratched
def manifest(scratch: Scratch, docs: DataFrame, columns: list[str], group: str = "source", order: str = "doc_id", keep: dict[str, Column] | None = None) -> DataFrame:
    """leaf, subroot, root, proof of each row of docs, and the columns of keep, expressions over docs.

    The leaf is the hash of the given columns.  Leaves of a group ascend by
    order, nulls first; rows that tie in it ascend by their leaf, and rows
    alike in all columns take neighbouring places, either one either.  A
    null group is a group of its own before the empty one.  Null and empty
    texts have different leaves; very long ones are hashed whole.  Only
    hashes and keys are shuffled, never texts.  proof leads from the leaf to the root over
    all groups.  An empty table gives an empty one.
    """
    spark, keep = docs.sparkSession, keep or {}
    node = described([F.col(c) for c in columns])
    kept = F.struct(node.alias("leaf"), *[c.alias(f"keep_{k}") for k, c in keep.items()])
    leaves = scratch.table(docs.select(F.col(group).cast("string").alias("group"), F.col(order).alias("order"), node.alias("node"), kept.alias("kept")), "leaves")
    own = trees(scratch, leaves, ["order"])
    # the groups' roots are the leaves of one more tree
    roots = own.select("group", "root").distinct()
    roots = scratch.table(roots.select(F.lit("").alias("group"), F.col("group").alias("order"), F.col("root").alias("node"), F.struct(F.col("group").alias("of")).alias("kept")), "roots")
    over = trees(scratch, roots, ["order"])
    over = small_side(scratch.table(over.select("kept.of", F.col("root").alias("top"), F.col("proof").alias("further")), "over"))
    out = own.join(over, F.col("group").eqNullSafe(F.col("of")))
    out = out.select("kept.leaf", *[F.col(f"kept.keep_{k}").alias(k) for k in keep], F.col("root").alias("subroot"), F.col("top").alias("root"), F.concat("proof", "further").alias("proof"))
    return write_and_read(out, new_path(spark, "manifest"))


COLUMNS = ["doc_id", "source", "lang", "n_chars", "text"]


def tampered_manifest(docs: DataFrame) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, and the root that follows where every other document has lost its line ends."""
    chosen = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    text = F.when(chosen, F.replace(F.col("text"), F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    changed = described([text if c == "text" else F.col(c) for c in COLUMNS])
    told = manifest(docs, COLUMNS, keep={"doc_id": F.col("doc_id").cast("long"), "changed": F.when(chosen, changed)})
    told = told.withColumn("folded_root", folded(F.coalesce("changed", "leaf"), F.col("proof")))
    return told.select("doc_id", "leaf", "subroot", "root", proof_digest(F.col("proof")).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))
