"""SimHash near-deduplication with a bit-sliced comparison of fingerprints.

Equal fingerprints are one node.  Each distinct fingerprint is dealt to six
tables, one for each pair of its four 16-bit parts: two fingerprints that
differ in at most two bits agree in at least two parts, so they meet in one of
the six.  Within a group of equal parts, 64 fingerprints at a time stand as
bit planes (plane p holds bit p of all of them in one machine word), and the
distances from a fingerprint to all 64 grow together in carry-save counters;
a block is abandoned once every one of its distances is past the radius.
Groups return a forest of their links, never all pairs.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .cells import by_cell, forest, pair_cells, whole_runs
from .components import connected_components
from .storage import Scratch, new_path, partitions, scratched, small_side, write_and_read

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SEED, SHINGLE, RADIUS = 42, 3, 2
UPPER_TO_LOWER = {c: c + 32 for c in range(65, 91)}
ONES = np.uint64(0xFFFFFFFFFFFFFFFF)
#: Most fingerprints of a group that one cell compares at once.
CELL_ROWS = 2048


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """The 64-bit fingerprint of a text; 0 where it has no word."""
    words = WORD.findall((text or "").translate(UPPER_TO_LOWER))
    if not words:
        return 0
    if len(words) < shingle:
        grams = [" ".join(words)]
    else:
        grams = map(" ".join, zip(*(words[i:] for i in range(shingle)), strict=False))
    digest = xxhash.xxh64_intdigest
    h = np.fromiter((digest(g.encode(), SEED) for g in grams), np.uint64)
    votes = np.zeros(64, np.int64)
    for at in range(0, len(h), 1 << 16):
        part = h[at : at + (1 << 16)].astype("<u8")
        votes += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * votes > len(h), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """doc_id, fp (the fingerprint as a signed long)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            fp = np.array([fingerprint(t, shingle) for t in batch["text"]], np.uint64)
            yield pd.DataFrame({"doc_id": batch["doc_id"], "fp": fp.view(np.int64)})

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return rows.mapInPandas(run, "doc_id long, fp long")


def slice_planes(blocks: np.ndarray) -> np.ndarray:
    """(n, 64, w) words of fingerprints as (64 * w planes, n): word [p, i] holds bit p of the 64 of block i."""
    n, _, w = blocks.shape
    bits = np.unpackbits(np.ascontiguousarray(blocks.astype("<u8")).view(np.uint8).reshape(n, 64, 8 * w), axis=2, bitorder="little")
    packed = np.packbits(bits.transpose(2, 0, 1), axis=2, bitorder="little")
    return np.ascontiguousarray(packed).view("<u8").reshape(64 * w, n)


def near_planes(planes: np.ndarray, sizes: np.ndarray, queries: np.ndarray, radius: int) -> np.ndarray:
    """For each block and its query, (n, w) words: a word whose bit j is set where lane j lies within radius.

    Only the first sizes[i] lanes of block i count.
    """
    counters = radius.bit_length()  # carry-save: counter k holds bit k of all distances
    lanes = np.where(sizes >= 64, ONES, (np.uint64(1) << np.minimum(sizes, 63).astype(np.uint64)) - np.uint64(1))
    out, live = np.zeros(len(queries), np.uint64), np.arange(len(queries))
    count = [np.zeros(len(queries), np.uint64) for _ in range(counters)]
    over, q = ~lanes, queries.astype(np.uint64)
    every = 4 if len(planes) <= 64 else 16
    for p in range(len(planes)):
        carry = planes[p, live] ^ (np.uint64(0) - ((q[:, p // 64] >> np.uint64(p % 64)) & np.uint64(1)))
        for k in range(counters):
            count[k], carry = count[k] ^ carry, count[k] & carry
        over |= carry
        if p % every == every - 1:
            stay = (over | _beyond(count, radius)) != ONES
            if not stay.all():  # blocks whose distances are all past the radius are abandoned
                live, over, q = live[stay], over[stay], q[stay]
                count = [c[stay] for c in count]
            if not len(live):
                return out
    out[live] = ~(over | _beyond(count, radius))
    return out


def _beyond(count: list[np.ndarray], radius: int) -> np.ndarray:
    """Lanes whose counter exceeds radius: a bitwise comparison from the highest bit down."""
    more, equal = np.zeros_like(count[0]), np.full_like(count[0], ONES)
    for k in reversed(range(len(count))):
        if not radius >> k & 1:
            more |= equal & count[k]
            equal = equal & ~count[k]
        else:
            equal = equal & count[k]
    return more


def links_within(groups: list[tuple[np.ndarray, np.ndarray, np.ndarray]], radius: int) -> tuple[np.ndarray, np.ndarray]:
    """For cells (ids, (n, w) fingerprints, chunk of each): a forest of the links within radius."""
    out_a, out_b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    small = sorted((g for g in groups if len(g[0]) <= 64), key=lambda g: -len(g[0]))
    for s in range(0, len(small), 1024):
        part = small[s : s + 1024]
        sizes = np.array([len(g[0]) for g in part])
        blocks, ids = np.zeros((len(part), 64, part[0][1].shape[1]), np.uint64), np.zeros((len(part), 64), np.int64)
        for i, (own, fp, _) in enumerate(part):
            blocks[i, : len(fp)], ids[i, : len(fp)] = fp, own
        planes = slice_planes(blocks)
        for j in range(int(sizes[0]) - 1):
            n = int((sizes > j + 1).sum())
            words = near_planes(planes[:, :n], sizes[:n], blocks[:n, j], radius) & ~np.uint64((1 << (j + 1)) - 1)
            i = np.flatnonzero(words)
            r, lane = np.nonzero(np.unpackbits(words[i].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"))
            out_a.append(ids[i[r], j]), out_b.append(ids[i[r], lane])
    for own, fp, chunk in groups:
        if len(own) > 64:
            a, b = _large(own, fp, chunk, radius)
            out_a.append(a), out_b.append(b)
    return _thin(np.concatenate(out_a), np.concatenate(out_b))


def _thin(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    root = forest(len(nodes), at[: len(a)], at[len(a) :])
    told = np.flatnonzero(root != np.arange(len(nodes)))
    return nodes[told], nodes[root[told]]


def _large(ids: np.ndarray, fp: np.ndarray, chunk: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """One large cell; of two chunks, only pairs across them are compared."""
    cross = chunk.min() != chunk.max()
    left = chunk == chunk.min() if cross else np.ones(len(ids), bool)
    right = ~left if cross else left
    l_ids, l_fp, r_ids, r_fp = ids[left], fp[left], ids[right], fp[right]
    words = -(-len(r_ids) // 64)
    blocks = np.zeros((words * 64, fp.shape[1]), np.uint64)
    blocks[: len(r_fp)] = r_fp
    planes, sizes = slice_planes(blocks.reshape(words, 64, -1)), np.minimum(64, len(r_ids) - 64 * np.arange(words))
    a, b = np.zeros(0, np.int64), np.zeros(0, np.int64)
    step = max(1, (1 << 16) // words)
    for s in range(0, len(l_ids), step):
        part = l_fp[s : s + step]
        # a query against every block: the block's number runs fastest
        hits = near_planes(np.tile(planes, len(part)), np.tile(sizes, len(part)), np.repeat(part, words, axis=0), radius)
        i = np.flatnonzero(hits)
        r, lane = np.nonzero(np.unpackbits(hits[i].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"))
        x, y = l_ids[s + i[r] // words], r_ids[(i[r] % words) * 64 + lane]
        a, b = _thin(np.concatenate([a, x]), np.concatenate([b, y]))
    return a, b


@scratched
def simhash_dedup(scratch: Scratch, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """One row for each row of docs: doc_id, fingerprint, component_id, kept.

    component_id is the smallest doc_id that links reach, its own included;
    kept is doc_id = component_id.  Null text counts as empty, and an empty
    text has fingerprint 0, which links like any other.  Rows with a null
    doc_id get a fingerprint and the component of it; where no row of a
    component has an id, component_id is null.  Rows that repeat a doc_id each
    have their own row.  Very long texts count whole; a bit that exactly half
    of the shingles set is 0.  An empty table gives an empty one.
    """
    if not 1 <= radius <= 2:
        raise ValueError("the four-part tables are exact for a radius of 1 or 2")
    rows = scratch.table(fingerprints(docs, id_col, text_col, shingle), "fingerprints")
    distinct = scratch.table(rows.groupBy("fp").agg(F.min("doc_id").alias("rep")), "distinct")
    parts = [F.shiftrightunsigned("fp", 16 * k).bitwiseAND(F.lit(0xFFFF)) for k in range(4)]
    pairs = [(i, j) for i in range(4) for j in range(i)]
    keys = [F.lit(t << 32).bitwiseOR(F.shiftleft(parts[i], 16)).bitwiseOR(parts[j]) for t, (i, j) in enumerate(pairs)]
    dealt = distinct.select("fp", F.explode(F.array(*keys)).alias("key"))
    cells = pair_cells(dealt, "key", "fp", CELL_ROWS)

    def work(groups: list[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        made = [(fp := g["fp"].to_numpy(), fp.view(np.uint64)[:, None], g["chunk"].to_numpy()) for g in groups]
        a, b = links_within(made, radius)
        yield pd.DataFrame({"a": a, "b": b})

    links = by_cell(cells, "key", work, "a long, b long")
    found = connected_components(links, "a", "b", scratch)
    joined = distinct.join(found, distinct.fp == found.node, "left").select("fp", "rep", F.coalesce("component", "fp").alias("component"))
    joined = scratch.table(joined, "members")
    least = joined.groupBy("component").agg(F.min("rep").alias("component_id"))
    ids = scratch.table(joined.join(least, "component").select("fp", "component_id"), "ids")
    out = rows.join(ids, "fp").select(
        "doc_id",
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        "component_id",
        F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"),
    )
    return write_and_read(out, new_path(docs.sparkSession, "simhash"))


#: Words of a wide fingerprint.
WIDE = 8
#: A pair at Jaccard similarity s is compared with a probability of 1 - (1 - s**ROWS)**BANDS, in a table of any size:
#: 0.9999 at 0.8, and more above it.  Other similarities get as many bands as they need for the same.
ROWS, BANDS = 5, 24
#: Shingles below which a set's fingerprint says too little.
FEW = 20
#: Most sets, and most bytes of sets, that one cell verifies; the shingles taken at a time.
SET_CELL_ROWS, SET_CELL_BYTES, SET_COLUMNS = 1024, 8 << 20, 8192


def radius_for(similarity: float, bits: int) -> int:
    """Differing bits that all but one in some ten thousand pairs of a Jaccard similarity stay within.

    The angle between two sets gives the mean; to it four standard deviations
    and two bits.  Holds for sets of FEW shingles and more; of fewer, ties move
    the mean, and such sets are taken as candidates without the comparison.
    """
    share = np.arccos(2 * similarity / (1 + similarity)) / np.pi
    return int(np.ceil(bits * share + 4 * np.sqrt(bits * share * (1 - share)))) + 2


def shingles(text: str | None, shingle: int) -> np.ndarray:
    """64-bit hashes of the distinct shingles of a text; the whole text where it has fewer words; none without a word."""
    words = WORD.findall((text or "").translate(UPPER_TO_LOWER))
    if not words:
        return np.zeros(0, np.uint64)
    grams = {" ".join(words)} if len(words) < shingle else set(map(" ".join, zip(*(words[i:] for i in range(shingle)), strict=False)))
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(g.encode(), SEED) for g in grams), np.uint64, len(grams))


def wide_fingerprint(h: np.ndarray) -> bytes:
    """64 * WIDE bits: the majority of each bit over the hashes of a set."""
    votes = np.zeros(64 * WIDE, np.int64)
    for at in range(0, len(h), 1 << 12):
        own = h[at : at + (1 << 12)]
        mixed = np.stack([own * np.uint64(2 * k * 0x9E3779B97F4A7C15 + 1 & int(ONES)) for k in range(WIDE)], axis=1)
        mixed = (mixed ^ (mixed >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
        mixed ^= mixed >> np.uint64(29)
        bits = np.unpackbits(np.ascontiguousarray(mixed).view(np.uint8).reshape(len(own), 8 * WIDE), axis=1, bitorder="little")
        votes += bits.sum(axis=0, dtype=np.int32)
    return np.packbits(2 * votes > len(h), bitorder="little").tobytes()


def bands_for(similarity: float) -> int:
    """Bands that miss a pair at this similarity as rarely as BANDS do at 0.8."""
    return max(1, int(np.ceil(BANDS * np.log1p(-(0.8**ROWS)) / np.log1p(-(min(similarity, 0.999) ** ROWS)))))


def band_keys(h: np.ndarray, factors: np.ndarray) -> np.ndarray:
    """One key for each row of factors (bands, ROWS): a hash of the least shingles in ROWS orders."""
    least = np.full(factors.size, ONES)
    for at in range(0, len(h), 1 << 11):
        np.minimum(least, (h[at : at + (1 << 11), None] * factors.ravel()).min(axis=0), out=least)
    keys = np.arange(1, len(factors) + 1, dtype=np.uint64)
    for column in least.reshape(factors.shape).T:
        keys = (keys ^ column) * np.uint64(0x9E3779B97F4A7C15)
        keys ^= keys >> np.uint64(32)
    return keys.view(np.int64)


def similar(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the pairs (one of left, another of right) whose Jaccard similarity is at least the given one."""
    sizes = np.array([len(s) for s in sets])
    _, column, seen = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(sets)), sizes)
    shared = seen[column] > 1  # what only one set has is in no intersection
    row, column = row[shared], np.unique(column[shared], return_inverse=True)[1]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    both = np.zeros((len(left), len(right)), np.float32)  # exact: counts below 2**24
    for at in range(0, int(column[-1]) + 1 if len(column) else 0, SET_COLUMNS):
        a, b = np.searchsorted(column, [at, at + SET_COLUMNS])
        has = np.zeros((len(sets), int(column[b - 1]) - at + 1), np.float32)
        has[row[a:b], column[a:b] - at] = 1
        both += has[left] @ has[right].T
    near = both >= similarity * (sizes[left][:, None] + sizes[right] - both.astype(np.float64)) - 1e-9
    i, j = np.nonzero(near)
    apart = left[i] != right[j]
    return left[i[apart]], right[j[apart]]


def own_of(h: np.ndarray) -> int:
    """One long for a set of shingles."""
    return xxhash.xxh64_intdigest(np.sort(h).astype("<u8").tobytes(), SEED) - (1 << 63)


@scratched
def near_groups(scratch: Scratch, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """doc_id, own, component_id, stays of every document with an id and a word, for similarities far below a few bits of 64.

    own names a document's set of shingles; stays marks the rows of the group's
    smallest doc_id, and of the smallest own where that id has several sets.

    Two documents are linked where the Jaccard similarity of their sets of
    shingles is the given one or more; shingles count as equal where their
    64-bit hashes are.  Documents of one set are one node.  Three steps:

    * Candidates: nodes that agree in a band, each the least shingles in ROWS
      orders, and whose wide fingerprints the bit-sliced comparison finds within
      radius_for: both shares depend on the similarity alone, not on the number
      of documents.  Groups return forests, whose components are clusters.
    * Verification: the sets of a cluster travel once, in chunks of bounded
      rows and bytes that all hold the cluster's pivot.  All pairs of a chunk
      are verified on the whole sets.
    * Only sets that no chunk has joined to the pivot meet the other chunks, so
      a tight cluster of any size costs one pass over its sets.

    Repeated rows and ties are one node; null and empty texts, and rows
    without an id, are no part of it; an empty table gives an empty one.
    """
    n = partitions(docs.sparkSession)
    factors = np.random.default_rng(1000).integers(0, 1 << 63, (bands_for(similarity), ROWS)).astype(np.uint64) * np.uint64(2) + np.uint64(1)
    radius = radius_for(similarity, 64 * WIDE)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            made = [(i, own_of(h), 8 * len(h), wide_fingerprint(h), band_keys(h, factors)) for i, t in zip(batch["doc_id"], batch["text"], strict=True) if len(h := shingles(t, shingle))]
            yield pd.DataFrame(made, columns=["doc_id", "own", "bytes", "fp", "keys"])

    def sets_of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            made = [(c, own, np.sort(h).astype("<u8").tobytes()) for c, own, t in zip(batch["cluster"], batch["own"], batch["text"], strict=True) if own_of(h := shingles(t, shingle)) == own]
            yield pd.DataFrame(made, columns=["cluster", "own", "set"])

    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).where("doc_id IS NOT NULL AND text IS NOT NULL")
    rows = scratch.table(texts.mapInPandas(run, "doc_id long, own long, bytes long, fp binary, keys array<long>"), "bands")
    nodes = scratch.table(rows.groupBy("own").agg(F.min("doc_id").alias("rep"), *[F.first(c).alias(c) for c in ("bytes", "fp", "keys")]), "nodes")
    dealt = nodes.select("own", F.explode("keys").alias("key"))
    # groups of the same members are compared once
    members = [F.bit_xor(F.xxhash64(F.lit(k), "own")).alias(f"m{k}") for k in (1, 2)]
    groups = dealt.groupBy("key").agg(F.count("*").alias("rows"), *members).where("rows > 1")
    groups = groups.groupBy("rows", "m1", "m2").agg(F.min("key").alias("key")).select("key").repartition(n)
    cells = scratch.table(pair_cells(dealt.join(groups, "key"), "key", "own", CELL_ROWS), "cells")

    def compare(found: list[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        made = [(g["own"].to_numpy(), np.frombuffer(b"".join(g["fp"]), "<u8").reshape(len(g), WIDE), g["chunk"].to_numpy()) for g in found]
        a, b = links_within(made, radius)
        few = [g["own"].to_numpy()[g["bytes"].to_numpy() < 8 * FEW] for g in found]
        out_a, out_b = np.concatenate([a, *[x[1:] for x in few]]), np.concatenate([b, *[np.repeat(x[:1], max(0, len(x) - 1)) for x in few]])
        yield pd.DataFrame({"a": out_a, "b": out_b})

    wide = by_cell(cells.join(nodes.select("own", "fp", "bytes"), "own"), "key", compare, "a long, b long")
    clusters = connected_components(wide, "a", "b", scratch).withColumnRenamed("component", "cluster")
    inside = scratch.table(nodes.join(clusters, nodes.own == clusters.node).select("cluster", "own", "rep", "bytes"), "inside")
    sizes = inside.groupBy("cluster").agg(F.greatest(F.ceil(F.count("*") / F.lit(SET_CELL_ROWS)), F.ceil(F.sum("bytes") / F.lit(SET_CELL_BYTES))).cast("int").alias("chunks"))
    # only documents of a cluster have their sets made and moved
    asked = small_side(inside.select("cluster", "own", F.col("rep").alias("doc_id")))
    sets = texts.join(asked, "doc_id").select("cluster", "own", "text").mapInPandas(sets_of, "cluster long, own long, set binary")
    # rows that share a doc_id may make a set twice
    sets = scratch.table(sets.join(sizes.repartition(n), "cluster").withColumn("chunk", F.pmod(F.xxhash64("own"), F.col("chunks")).cast("int")), "sets")

    def verify(key: list[str], cross: bool):
        def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for found in whole_runs(batches, key):
                out_a, out_b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
                for g in found:
                    g = g.drop_duplicates(["own", "side"] if cross else "own")
                    if len(g) < 2:
                        continue
                    own, left = g["own"].to_numpy(), g["side"].to_numpy() == 0
                    i, j = similar([np.frombuffer(s, "<u8") for s in g["set"]], np.flatnonzero(left), np.flatnonzero(~left if cross else left), similarity)
                    a, b = _thin(own[i], own[j])
                    out_a.append(a), out_b.append(b)
                yield pd.DataFrame(dict(zip("ab", _thin(np.concatenate(out_a), np.concatenate(out_b)), strict=True)))

        return work

    every = F.sequence(F.lit(0), F.col("chunks") - 1)
    pivot = F.col("own") == F.col("cluster")  # a cluster's name is its least node
    once = sets.withColumn("chunk", F.explode(F.when(pivot, every).otherwise(F.array("chunk")))).select("cluster", "chunk", "own", F.lit(0).alias("side"), "set")
    keys = ["cluster", "chunk"]
    links = scratch.table(once.repartition(n, *keys).sortWithinPartitions(*keys).mapInPandas(verify(keys, False), "a long, b long"), "verified")
    large = sets.where("chunks > 1")
    if not large.isEmpty():
        joined = connected_components(links, "a", "b", scratch).select("node", F.col("component").alias("part"))
        parts = inside.select("cluster", "own").join(joined, F.col("own") == F.col("node"), "left").select("cluster", "own", F.coalesce("part", "own").alias("part"))
        of_pivot = parts.where(pivot).select("cluster", F.col("part").alias("main")).repartition(n)
        left_out = scratch.table(parts.join(of_pivot, "cluster").where("part <> main").select("own"), "left-out")
        alone = large.join(left_out, "own", "left_semi")
        many = alone.groupBy("cluster").agg(F.greatest(F.ceil(F.count("*") / F.lit(SET_CELL_ROWS)), F.ceil(F.sum(F.length("set")) / F.lit(SET_CELL_BYTES))).cast("int").alias("others")).repartition(n)
        alone = alone.join(many, "cluster").withColumn("other", F.pmod(F.xxhash64(F.lit(7), "own"), F.col("others")).cast("int")).withColumn("chunk", F.explode(every))
        against = large.join(many, "cluster").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("others") - 1)))
        keys = ["cluster", "chunk", "other"]
        both = alone.select(*keys, "own", F.lit(0).alias("side"), "set").unionByName(against.select(*keys, "own", F.lit(1).alias("side"), "set"))
        cross = both.repartition(n, *keys).sortWithinPartitions(*keys).mapInPandas(verify(keys, True), "a long, b long")
        links = scratch.table(links.unionByName(cross), "all-links")
    found = connected_components(links, "a", "b", scratch)
    known = nodes.join(found, nodes.own == found.node, "left").select("own", "rep", F.coalesce("component", "own").alias("component"))
    known = scratch.table(known, "members")
    first = known.groupBy("component").agg(F.min(F.struct("rep", "own")).alias("first"))
    known = known.join(first, "component").select("own", "first")
    told = rows.select("doc_id", "own").join(known, "own")
    stays = (F.col("doc_id") == F.col("first.rep")) & (F.col("own") == F.col("first.own"))
    return write_and_read(told.select("doc_id", "own", F.col("first.rep").alias("component_id"), stays.alias("stays")), new_path(docs.sparkSession, "near"))


def keep_near(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """docs with one document of each group of near copies, that of the smallest doc_id, all columns as they were.

    Documents without an id or a word stay.  Rows that share a doc_id are told
    apart by their sets of shingles, so a row never goes because another row
    of its id has a copy; of rows with the same id and set one stays.  Very
    long texts are compared whole; an empty table gives an empty one.
    """
    found = near_groups(docs, id_col, text_col, shingle, similarity)
    gone = found.where("NOT stays").select(F.col("doc_id").alias("__llm_id")).distinct()
    key = F.col(id_col).cast("long")
    ids = docs.select(key.alias("__llm_id")).where("__llm_id IS NOT NULL")
    twice = small_side(write_and_read(ids.groupBy("__llm_id").count().where("count > 1").select("__llm_id"), new_path(docs.sparkSession, "twice")))
    if twice.isEmpty():
        return docs.join(small_side(gone), key == F.col("__llm_id"), "left_anti")

    @F.pandas_udf("long")
    def own(texts: pd.Series) -> pd.Series:
        sets = (shingles(t, shingle) for t in texts)
        return pd.Series([own_of(h) if len(h) else None for h in sets], dtype="Int64")

    plain = docs.join(twice, key == F.col("__llm_id"), "left_anti").join(small_side(gone), key == F.col("__llm_id"), "left_anti")
    shared = docs.join(twice, key == F.col("__llm_id"), "left_semi").withColumns({"__llm_id": key, "__llm_own": own(F.col(text_col))})
    stay = found.where("stays").select(F.col("doc_id").alias("__llm_id"), F.col("own").alias("__llm_own")).distinct()
    once = shared.where("__llm_own IS NOT NULL").join(stay, ["__llm_id", "__llm_own"], "left_semi").dropDuplicates(["__llm_id", "__llm_own"])
    wordless = shared.where("__llm_own IS NULL")
    return plain.unionByName(once.unionByName(wordless).select(*docs.columns))
