"""Removal of byte strings that an earlier document holds, by difference-cover sampling.

The suffixes of all documents are never sorted whole: two strings of 50 bytes
only have to be told equal, so the difference-cover scheme is cut off at 50.

1. Sample.  In every document the suffixes at positions i with i mod v in a
   perfect difference cover of v are sampled.  For any two positions one
   shift k < v brings both into the sample, so each 50-byte match contains a
   sampled window of 50 - v + 1 bytes on both sides.
2. Names.  The sampled tuples are dealt to buckets by value, sorted, and named;
   adjacent equal names that come from different documents are kept.
3. Recursion.  Only positions that have such a name within their next v
   positions go on: the names of the next level are those of the full 50 bytes.
4. Merge.  These remaining suffixes are dealt to buckets and sorted with the
   first holder in front; adjacent equal prefixes past the first holder's
   document are what is removed.

Texts are held as blocks of consecutive doc_ids in a table bucketed by block,
so the three passes over them move nothing.  What travels is sorted name
lists, one for each block and bucket, in which a name counts once for a block
however often a hot passage repeats there; the answer is a bit for each name.

A name is a 64-bit hash of its bytes, cut to 40 bits (filter) or 56 bits
(final) beside the bucket, which comes from a second hash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import Scratch, new_path, partitions, release_shuffles, scratched, write_and_read

#: Perfect difference covers: every residue other than 0 is a difference exactly once.
COVERS = {7: (0, 1, 3), 13: (0, 1, 3, 9), 21: (0, 1, 4, 14, 16)}
FIRST_BITS, LAST_BITS = 40, 56
#: Bytes of text in a block, and names in a bucket, on average.
BLOCK_BYTES, BUCKET_NAMES = 8 << 20, 2_000_000
#: Spark's own limit, spark.sql.sources.bucketing.maxBuckets.
MOST_BUCKETS = 100_000
U = np.uint64


def cover_for(length: int) -> tuple[int, tuple[int, ...]]:
    """The largest cover that leaves windows of 16 bytes and more."""
    fit = [v for v in COVERS if length - v + 1 >= 16]
    if not fit:
        raise ValueError("matches must have 22 bytes at least")
    return max(fit), COVERS[max(fit)]


def _mix(h: np.ndarray, k: int) -> np.ndarray:
    h = h * U(k)
    return h ^ (h >> U(29))


def _hash(words: np.ndarray, at: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of the length bytes at each position; words: the 8 bytes from each position on."""
    a, b = np.full(len(at), length, U), np.zeros(len(at), U)
    for o in [*range(0, length - 7, 8), *([length - 8] if length % 8 else [])]:
        w = words[at + o]
        a = _mix(a ^ w, 0xBF58476D1CE4E5B9)
        b = (b + w) * U(0x9E3779B97F4A7C15)
    return _mix(_mix(a, 0x94D049BB133111EB), 0xD6E8FEB86659FD93), _mix(b ^ (b >> U(32)), 0xFF51AFD7ED558CCD)


def pack_sorted(keys: np.ndarray) -> bytes:
    """Ascending 64-bit keys as differences, cut to as many bytes as the largest needs."""
    gaps = np.diff(keys, prepend=U(0)).astype("<u8")
    width = max(1, (int(gaps.max()).bit_length() + 7) // 8) if len(gaps) else 1
    return bytes([width]) + gaps.view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()


def unpack_sorted(blob: bytes) -> np.ndarray:
    width = blob[0]
    raw = np.frombuffer(blob, np.uint8, offset=1).reshape(width, -1)
    gaps = np.zeros((raw.shape[1], 8), np.uint8)
    gaps[:, :width] = raw.T
    return np.cumsum(gaps.view("<u8").ravel(), dtype=U)


class Names:
    """Names of one level in a block: their order, and the list for each bucket."""

    def __init__(self, at: np.ndarray, doc: np.ndarray, hashes: tuple[np.ndarray, np.ndarray], bits: int, buckets: int):
        key = hashes[0] & U((1 << bits) - 1)
        bucket = (hashes[1] % U(buckets)).astype(np.int32)
        order = np.lexsort((key, bucket)) if buckets > 1 else np.argsort(key, kind="stable")
        self.at, key, bucket, doc = at[order], key[order], bucket[order], doc[order]
        new = np.ones(len(key), bool)
        new[1:] = (key[1:] != key[:-1]) | (bucket[1:] != bucket[:-1])
        self.start = np.flatnonzero(new)
        self.group = np.cumsum(new) - 1
        self.key, self.bucket = key[new], bucket[new]
        self.doc = doc
        self.first = np.minimum.reduceat(doc, self.start) if len(doc) else doc
        self.last = np.maximum.reduceat(doc, self.start) if len(doc) else doc

    def lists(self) -> Iterator[tuple[int, bytes]]:
        if not len(self.bucket):
            return
        cuts = np.flatnonzero(np.r_[True, self.bucket[1:] != self.bucket[:-1]])
        for a, b in zip(cuts, [*cuts[1:], len(self.bucket)], strict=True):
            yield int(self.bucket[a]), pack_sorted(self.key[a:b])

    def answers(self, bits: dict[int, bytes]) -> np.ndarray:
        """A bit for each name, put together from the buckets' answers."""
        out = [np.unpackbits(np.frombuffer(bits[k], np.uint8)) for k in sorted(bits)]
        sizes = np.bincount(self.bucket, minlength=max(bits, default=0) + 1) if len(self.bucket) else np.zeros(1, int)
        parts = [x[: sizes[k]] for k, x in zip(sorted(bits), out, strict=True)]
        return np.concatenate(parts).astype(bool) if parts else np.zeros(0, bool)


class Block:
    """The texts of a block, each (doc_id, digest) once, without those that are copies of an earlier document."""

    def __init__(self, texts: pa.Table, told: pa.Table, length: int, buckets: int):
        self.length, self.buckets = length, buckets
        self.ids, self.digests = texts["doc_id"].to_pylist(), texts["digest"].to_pylist()
        kinds, bucket, blobs = told["kind"].to_pylist(), told["bucket"].to_pylist(), told["blob"].to_pylist()
        copies = {x for k, x in zip(kinds, blobs, strict=True) if k == 0}
        self.bits = {want: {b: x for k, b, x in zip(kinds, bucket, blobs, strict=True) if k == want} for want in (1, 2)}
        self.copy = [i.to_bytes(8, "little", signed=True) + d in copies for i, d in zip(self.ids, self.digests, strict=True)]
        data = texts["data"].to_pylist()
        self.sizes = [len(x) for x in data]
        seen: dict[tuple[int, bytes], int] = {}
        for row in sorted(range(len(self.ids)), key=lambda r: self.ids[r]):
            if not self.copy[row]:
                seen.setdefault((self.ids[row], self.digests[row]), row)
        self.rows = list(seen.values())
        self.raw = b"".join([*(data[r] for r in self.rows), bytes(8)])
        size = np.array([self.sizes[r] for r in self.rows], np.int64)
        self.end = np.cumsum(size)
        self.start = self.end - size
        self.n = int(self.end[-1]) if len(size) else 0
        # rows of one doc_id are one document where earlier ones are asked for
        ids = np.array([self.ids[r] for r in self.rows], np.int64)
        self.rank = np.cumsum(np.r_[False, ids[1:] != ids[:-1]]).astype(np.int32) if len(ids) else np.zeros(0, np.int32)
        self.words = np.ndarray((self.n + 1,), "<u8", self.raw, strides=(1,))
        self.v, self.cover = cover_for(length)

    def sampled(self) -> Names:
        window = self.length - self.v + 1
        size = self.end - self.start
        top = int(size.max()) if len(size) else 0
        grid = (np.arange(0, top + self.v, self.v)[:, None] + np.array(self.cover)).ravel()
        many = np.searchsorted(grid, size - window, side="right")
        many[size < self.length] = 0
        at = np.concatenate([grid[:m] + s for m, s in zip(many, self.start, strict=True)]) if self.n else np.zeros(0, np.int64)
        return Names(at, np.repeat(self.rank, many), _hash(self.words, at, window), FIRST_BITS, self.buckets)

    def remaining(self) -> Names:
        """Names of all positions whose next v positions hold a sampled window of another document too."""
        names = self.sampled()
        good = names.answers(self.bits[1]) | (names.first != names.last)
        mark = np.zeros(self.n + self.v + 1, np.int32)
        mark[names.at[good[names.group]] + 1] = 1
        mark = np.cumsum(mark)
        some = mark[self.v : self.n + self.v] > mark[: self.n]
        for s, e in zip(self.start, self.end, strict=True):
            some[max(s, e - self.length + 1) : e] = False
        at = np.flatnonzero(some)
        doc = self.rank[np.searchsorted(self.end, at, side="right")]
        return Names(at, doc, _hash(self.words, at, self.length), LAST_BITS, self.buckets)

    def result(self) -> pa.Table:
        names = self.remaining()
        earlier = names.answers(self.bits[2])[names.group] | (names.doc > names.first[names.group])
        at = names.at[earlier]
        edge = np.zeros(self.n + self.length + 1, np.int32)
        edge[at] += 1
        edge[at + self.length] -= 1
        gone = np.cumsum(edge)[: self.n] > 0
        raw = np.frombuffer(self.raw, np.uint8)[: self.n]
        told: dict[tuple[int, bytes], tuple[int, int, str]] = {}
        for r, s, e in zip(self.rows, self.start, self.end, strict=True):
            own = gone[s:e]
            many = int(own.sum())
            sha = hashlib.sha256(raw[s:e][~own].tobytes()).hexdigest() if many else self.digests[r].hex()
            told[(self.ids[r], self.digests[r])] = (many, int(own[:1].sum() + (own[1:] & ~own[:-1]).sum()), sha)
        out = []
        for row, (i, d, size) in enumerate(zip(self.ids, self.digests, self.sizes, strict=True)):
            if self.copy[row]:
                whole = size >= self.length
                out.append((size, 1, EMPTY) if whole else (0, 0, d.hex()))
            else:
                out.append(told[(i, d)])
        many, spans, sha = zip(*out, strict=True) if out else ((), (), ())
        return pa.table({"doc_id": pa.array(self.ids, pa.int64()), "n_bytes": pa.array(self.sizes, pa.int64()), "n_removed": pa.array(many, pa.int64()), "n_spans": pa.array(spans, pa.int64()), "kept_sha256": pa.array(sha, pa.string())})


EMPTY = hashlib.sha256().hexdigest()


def _lists(block: int, names: Names) -> pa.Table:
    rows = list(names.lists())
    return pa.table({"bucket": pa.array([b for b, _ in rows], pa.int32()), "block": pa.array([block] * len(rows), pa.int32()), "blob": pa.array([x for _, x in rows], pa.binary())})


def _same(lists: pa.Table, first_only: bool) -> pa.Table:
    """Of one bucket: for each block, a bit for each name: another block has it (first_only: an earlier one)."""
    lists = lists.sort_by("block")
    keys = [unpack_sorted(x.as_py()) for x in lists["blob"]]
    sizes = np.array([len(k) for k in keys])
    order = np.argsort(np.concatenate(keys), kind="stable")  # of equal keys, the first block leads
    key = np.concatenate(keys)[order]
    equal = key[1:] == key[:-1]
    bit = np.zeros(len(key), bool)
    bit[1:] |= equal
    if not first_only:
        bit[:-1] |= equal
    back = np.empty(len(key), bool)
    back[order] = bit
    cuts = np.cumsum(sizes)[:-1]
    return pa.table({"block": lists["block"], "kind": pa.array([2 if first_only else 1] * len(keys), pa.int32()), "bucket": lists["bucket"], "blob": pa.array([np.packbits(x).tobytes() for x in np.split(back, cuts)], pa.binary())})


TOLD = "block int, kind int, bucket int, blob binary"


@scratched
def suffix_dedup(scratch: Scratch, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 50) -> DataFrame:
    """One row for each row of docs: doc_id, n_bytes, n_removed, n_spans, kept_sha256.

    Every byte is removed that a string of length bytes covers which also
    starts in a document with a smaller doc_id.  Texts are UTF-8 bytes, null
    is empty.  Strings are judged on the input.  Rows that share a doc_id
    remove nothing from each other; rows without one keep everything and
    remove nothing.  Very long texts are compared whole.  An empty table gives
    an empty one.
    """
    spark = docs.sparkSession
    cover_for(length)
    text = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.unhex(F.sha2(text, 256)).alias("digest"), text.alias("data"))
    total = rows.agg(F.sum(F.length("data"))).first()[0] or 0
    blocks = max(1, -(-total // BLOCK_BYTES))
    v, cover = cover_for(length)
    buckets = max(1, min(1 << 20, -(-total * len(cover) // (v * BUCKET_NAMES))))
    ranged = rows.where("doc_id IS NOT NULL").repartitionByRange(blocks, "doc_id").withColumn("block", F.spark_partition_id())
    # a bucket holds several blocks where there are more than a table may have buckets
    texts = scratch.bucketed(ranged, min(max(blocks, partitions(spark)), MOST_BUCKETS), "block")
    release_shuffles(spark)
    slim = texts.select("block", "doc_id", "digest")
    least = slim.groupBy("digest").agg(F.min("doc_id").alias("least"), F.count("*").alias("rows")).where("rows > 1").drop("rows")
    least = least.repartition(partitions(spark))
    copies = slim.join(least, "digest").where("doc_id > least")

    def eight(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys = [i.to_bytes(8, "little", signed=True) + d for i, d in zip(b["doc_id"].to_pylist(), b["digest"].to_pylist(), strict=True)]
            n = len(keys)
            yield pa.RecordBatch.from_arrays([b["block"], pa.array([0] * n, pa.int32()), pa.array([0] * n, pa.int32()), pa.array(keys, pa.binary())], names=["block", "kind", "bucket", "blob"])

    told = scratch.table(copies.select("block", "doc_id", "digest").mapInArrow(eight, TOLD), "copies")

    def level(take: str):
        def run(left: pa.Table, right: pa.Table) -> pa.Table:
            if not left.num_rows:
                return _lists(0, Names(*(np.zeros(0, np.int64),) * 2, (np.zeros(0, U),) * 2, 8, 1))
            return _lists(left["block"][0].as_py(), getattr(Block(left, right, length, buckets), take)())

        return run

    def merge(first_only: bool):
        return lambda lists: _same(lists, first_only)

    def last(left: pa.Table, right: pa.Table) -> pa.Table:
        return Block(left, right, length, buckets).result()

    for take, first_only in (("sampled", False), ("remaining", True)):
        lists = texts.groupBy("block").cogroup(told.groupBy("block")).applyInArrow(level(take), "bucket int, block int, blob binary")
        same = lists.repartition(max(buckets, 1), "bucket").groupBy("bucket").applyInArrow(merge(first_only), TOLD)
        told = told.unionByName(scratch.table(same, take))
        del lists, same
        release_shuffles(spark)
    out = texts.groupBy("block").cogroup(told.groupBy("block")).applyInArrow(last, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
    nameless = rows.where("doc_id IS NULL").select("doc_id", F.length("data").cast("long").alias("n_bytes"), F.lit(0).cast("long").alias("n_removed"), F.lit(0).cast("long").alias("n_spans"), F.lower(F.hex("digest")).alias("kept_sha256"))
    return write_and_read(out.unionByName(nameless), new_path(spark, "suffixes"))
