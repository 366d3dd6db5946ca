"""A content-addressed store of token ids.

A store is a folder of Parquet tables that hold binary columns:

* ``chunks``: digest, n, payload.  A rolling hash over the last WINDOW ids
  cuts each document's ids into chunks; a chunk that occurs in many places is
  stored once, under the SHA-256 of its payload (ids as little-endian
  unsigned integers of 16 bits where all fit, of 32 otherwise; the payload's
  first byte says which).
* ``recipes``: doc_id, start, n_tokens, chunks (the digests in order), node (the
  SHA-256 over doc_id, n_tokens and the digests), part; in ascending doc_id.
* ``manifest``: part, rows, tokens, base, node: the Merkle node over the recipes of
  each part, and one row with part -1 whose node is the root over the parts.

Reading verifies payloads against digests, recipes against their nodes and
the manifest against the recipes.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .storage import Scratch, new_path, partitions, release_shuffles, scratched, write_and_read
from .tokens import ChunkEncoder

WINDOW, LEAST, MOST, CUT_BITS = 16, 64, 1024, 8
#: Parts, by digest, in which chunks are shuffled, so that the payloads of one part only lie in shuffle files at a time.
ROUNDS = 3
CHUNK = {"digest": pa.binary(), "n": pa.int32(), "payload": pa.binary()}


def cut(ids: np.ndarray, doc_ends: np.ndarray) -> tuple[list[int], list[int]]:
    """Ends of the chunks of documents that follow one another, and how many chunks lie before each document's end.

    A chunk ends where the rolling hash of the last WINDOW ids has CUT_BITS
    zeros, LEAST to MOST ids after the last, and at the document's end.  As
    LEAST is more than WINDOW, no window that decides reaches into the
    document before.
    """
    h = (ids.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(31)
    total = np.cumsum(h * np.uint64(0xBF58476D1CE4E5B9), dtype=np.uint64)
    rolled = total[WINDOW:] - total[:-WINDOW]
    rolled = (rolled ^ (rolled >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    hits = np.flatnonzero(rolled >> np.uint64(64 - CUT_BITS) == 0) + WINDOW + 1
    stops = np.union1d(hits, doc_ends).tolist()
    final, ends, upto, last = iter(doc_ends.tolist()), [], [], 0
    doc_end = next(final, None)
    for e in stops:
        while e - last > MOST:
            last += MOST
            ends.append(last)
        if e - last >= LEAST or e == doc_end:
            ends.append(e)
            last = e
        if e == doc_end:
            upto.append(len(ends))
            doc_end = next(final, None)
    return ends, upto


def to_payload(ids: np.ndarray) -> bytes:
    return b"\x02" + ids.astype("<u2").tobytes() if ids.max(initial=0) < 65536 else b"\x04" + ids.astype("<u4").tobytes()


def from_payload(payload: bytes) -> np.ndarray:
    return np.frombuffer(payload, "<u2" if payload[0] == 2 else "<u4", offset=1).astype("<u4")


def node_of(doc_id: int | None, n_tokens: int, digests: list[bytes]) -> bytes:
    return hashlib.sha256(f"{doc_id}/{n_tokens}/".encode() + b"".join(digests)).digest()


class Merkle:
    """The root of a binary Merkle tree over nodes that come one by one; an odd node moves up as it is."""

    def __init__(self):
        self.tops: list[tuple[int, bytes]] = []  # roots of full trees, by falling height

    def add(self, node: bytes) -> None:
        height, own = 0, hashlib.sha256(b"\0" + node).digest()
        while self.tops and self.tops[-1][0] == height:
            own = hashlib.sha256(b"\1" + self.tops.pop()[1] + own).digest()
            height += 1
        self.tops.append((height, own))

    def root(self) -> bytes:
        if not self.tops:
            return hashlib.sha256(b"").digest()
        own = self.tops[-1][1]
        for _, left in reversed(self.tops[:-1]):
            own = hashlib.sha256(b"\1" + left + own).digest()
        return own


def merkle(nodes: list[bytes]) -> bytes:
    tree = Merkle()
    for node in nodes:
        tree.add(node)
    return tree.root()


@scratched
def write_store(scratch: Scratch, docs: DataFrame, path: str, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> bytes:
    """Encodes whole texts, appends end_id to each, and writes a store; returns its Merkle root.

    Null text is empty.  Rows are stored in ascending doc_id, null first;
    rows of one doc_id in order of their content.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, seen = ChunkEncoder.of(tokenizer), set()
        for batch in batches:
            doc_ids = batch.column("doc_id").to_pylist()
            for first, beyond, e in encoder.encode(batch.column("text")):
                names = doc_ids[first:beyond]
                ids, doc_ends = np.insert(e.ids, e.ends, np.uint32(end_id)), e.ends + np.arange(1, len(e.ends) + 1)
                many = np.diff(doc_ends, prepend=0).tolist()
                ends, upto = cut(ids, doc_ends)
                short = int(ids.max(initial=0)) < 65536
                raw = ids.astype("<u2").tobytes() if short else b""
                digests, fresh, places, last = [], [], [], 0
                for end in ends:
                    payload = b"\x02" + raw[2 * last : 2 * end] if short else to_payload(ids[last:end])
                    d = hashlib.sha256(payload).digest()
                    digests.append(d)
                    if d not in seen:  # a chunk that this task has written is not written again
                        if len(seen) > 500_000:
                            seen.clear()
                        seen.add(d)
                        places.append(len(digests))
                        fresh.append((d, end - last, payload))
                    last = end
                upto = [0, *upto]
                nodes = [node_of(i, n, digests[a:b]) for i, n, a, b in zip(names, many, upto[:-1], upto[1:], strict=True)]
                fresh_upto = np.searchsorted(places, upto, side="right")
                columns = list(zip(*fresh, strict=True)) or [()] * len(CHUNK)
                items = pa.StructArray.from_arrays([pa.array(c, t) for c, t in zip(columns, CHUNK.values(), strict=True)], names=list(CHUNK))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(names, pa.int64()),
                        pa.array(many, pa.int64()),
                        pa.ListArray.from_arrays(pa.array(upto, pa.int32()), pa.array(digests, pa.binary())),
                        pa.array(nodes, pa.binary()),
                        pa.ListArray.from_arrays(pa.array(fresh_upto, pa.int32()), items),
                    ],
                    names=["doc_id", "n_tokens", "chunks", "node", "fresh"],
                )

    schema = "doc_id long, n_tokens long, chunks array<binary>, node binary, fresh array<struct<digest: binary, n: int, payload: binary>>"
    encoded = scratch.table(rows.mapInArrow(encode, schema), "encoded")
    found = encoded.select(F.explode("fresh").alias("c")).select("c.*")
    for k in range(ROUNDS):
        # a task has written a chunk once, so that even a frequent one has few rows; moved first, they are sorted only once
        some = found.where(F.pmod(F.crc32("digest"), F.lit(ROUNDS)) == k).repartition(partitions(spark), "digest").dropDuplicates(["digest"])
        some.write.mode("append").option("compression", "zstd").parquet(f"{path}/chunks")
        del some
        release_shuffles(spark)
    ordered = encoded.select("doc_id", "n_tokens", "chunks", "node").repartitionByRange(partitions(spark), "doc_id", "node")
    ordered = scratch.table(ordered.withColumn("part", F.spark_partition_id()).sortWithinPartitions("doc_id", "node"), "ordered")
    scratch.drop("encoded")
    del encoded
    release_shuffles(spark)
    sums = ordered.groupBy("part").agg(F.count("*").alias("rows"), F.sum("n_tokens").alias("tokens"))
    # one row for each partition
    base = sums.select("*", (F.sum("tokens").over(Window.orderBy("part")) - F.col("tokens")).alias("base"))
    running = F.sum("n_tokens").over(Window.partitionBy("part").orderBy("doc_id", "node").rowsBetween(Window.unboundedPreceding, 0))
    placed = ordered.withColumn("run", running).join(F.broadcast(base.select("part", "base")), "part")
    placed = placed.select("doc_id", (F.col("base") + F.col("run") - F.col("n_tokens")).alias("start"), "n_tokens", "chunks", "node", "part")
    placed.write.option("compression", "zstd").parquet(f"{path}/recipes")
    nodes = _part_nodes(spark.read.parquet(f"{path}/recipes")).join(F.broadcast(base), "part").select("part", "rows", "tokens", "base", "node")
    top = nodes.orderBy("part").select("part", "node", "rows", "tokens").collect()  # one row for each partition
    root = merkle([bytes(r.node) for r in top])
    total = spark.createDataFrame([(-1, sum(r.rows for r in top), sum(r.tokens for r in top), 0, bytearray(root))], "part int, rows long, tokens long, base long, node binary")
    nodes.unionByName(total).coalesce(1).write.parquet(f"{path}/manifest")
    return root


def _part_nodes(recipes: DataFrame) -> DataFrame:
    """The Merkle node of each part: sorted rows pass by, and only the tops of the tree are held."""

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, tree = None, None
        for batch in batches:
            for own, node in zip(batch["part"].tolist(), batch["node"], strict=True):
                if own != part:
                    if tree:
                        yield pd.DataFrame({"part": [part], "node": [tree.root()]})
                    part, tree = own, Merkle()
                tree.add(bytes(node))
        if tree:
            yield pd.DataFrame({"part": [part], "node": [tree.root()]})

    ordered = recipes.select("part", "start", "node").repartition(partitions(recipes.sparkSession), "part").sortWithinPartitions("part", "start", "node")
    return ordered.mapInPandas(fold, "part int, node binary")


def verify_manifest(spark: SparkSession, path: str) -> bytes:
    """Recomputes the Merkle nodes of all recipes; returns the root, or raises where the manifest says otherwise."""
    manifest = {r.part: bytes(r.node) for r in spark.read.parquet(f"{path}/manifest").select("part", "node").collect()}
    root = manifest.pop(-1)
    found = {r.part: bytes(r.node) for r in _part_nodes(spark.read.parquet(f"{path}/recipes")).collect()}
    if found != manifest or merkle([found[k] for k in sorted(found)]) != root:
        raise ValueError(f"{path}: the manifest does not match the recipes")
    return root


def _chunks(spark: SparkSession, path: str, payload: bool) -> DataFrame:
    """Chunks as read back, verified: digest, n, crc (of the ids decoded here) and, if asked for, payload."""

    def check(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            crc, n = [], []
            for d, p in zip(batch["digest"], batch["payload"], strict=True):
                if hashlib.sha256(p).digest() != bytes(d):
                    raise ValueError(f"chunk {bytes(d).hex()} is damaged")
                ids = from_payload(p)
                crc.append(zlib.crc32(ids.tobytes()))
                n.append(len(ids))
            out = pd.DataFrame({"digest": batch["digest"], "n": n, "crc": crc})
            yield out.assign(payload=batch["payload"]) if payload else out

    stored = spark.read.parquet(f"{path}/chunks").select("digest", "payload")
    return stored.mapInPandas(check, "digest binary, n int, crc long" + ", payload binary" * payload)


def _pieces(spark: SparkSession, path: str, payload: bool) -> DataFrame:
    recipes = spark.read.parquet(f"{path}/recipes")
    pieces = recipes.select("doc_id", "start", "n_tokens", F.posexplode("chunks").alias("k", "digest"))
    found = pieces.join(_chunks(spark, path, payload), "digest", "left")
    fields = ["k", F.coalesce("n", F.raise_error(F.lit("a chunk is missing from the store")).cast("int")).alias("n"), "crc", *["payload"] * payload]
    return found.groupBy("doc_id", "start", "n_tokens").agg(F.sort_array(F.collect_list(F.struct(*fields))).alias("pieces"))


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids (array<int>) of every document, put together from verified chunks."""

    def join(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            ids = [np.concatenate([from_payload(p["payload"]) for p in ps]).astype(np.int64) for ps in batch["pieces"]]
            yield batch[["doc_id", "start", "n_tokens"]].assign(ids=ids)

    return _pieces(spark, path, True).mapInPandas(join, "doc_id long, start long, n_tokens long, ids array<long>")


def document_checksums(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document from the files, without moving payloads.

    Each chunk is decoded and verified where it is read; a document's checksum
    is put together from those of its chunks.
    """

    def join(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            crc, n = [], []
            for ps in batch["pieces"]:
                whole, many = 0, 0
                for p in ps:
                    whole = crc32_combine(whole, int(p["crc"]), 4 * int(p["n"]))
                    many += int(p["n"])
                crc.append(whole)
                n.append(many)
            if (np.array(n) != batch["n_tokens"].to_numpy()).any():
                raise ValueError("a recipe's chunks do not add up to its ids")
            yield batch[["doc_id", "start", "n_tokens"]].assign(ids_crc32=crc)

    return _pieces(spark, path, False).mapInPandas(join, "doc_id long, start long, n_tokens long, ids_crc32 long")


_shifts: dict[int, list[int]] = {}


def _times(matrix: list[int], vector: int) -> int:
    out, i = 0, 0
    while vector:
        if vector & 1:
            out ^= matrix[i]
        vector >>= 1
        i += 1
    return out


def _shift(n_bytes: int) -> list[int]:
    """The 32 x 32 bit matrix that n zero bytes apply to a CRC-32 register."""
    if n_bytes not in _shifts:
        if len(_shifts) > 5000:
            _shifts.clear()
        power = [0xEDB88320, *(1 << k for k in range(31))]  # one zero bit
        result, bits = [1 << k for k in range(32)], 8 * n_bytes
        while bits:
            if bits & 1:
                result = [_times(power, x) for x in result]
            power = [_times(power, x) for x in power]
            bits >>= 1
        _shifts[n_bytes] = result
    return _shifts[n_bytes]


def crc32_combine(a: int, b: int, b_bytes: int) -> int:
    """The CRC-32 of two byte strings after one another, from those of each."""
    return _times(_shift(b_bytes), a) ^ b if b_bytes else a


def store_checksums(docs: DataFrame, tokenizer: str, end_id: int, path: str | None = None) -> DataFrame:
    """Writes a store of docs, verifies it and returns what its files say of each document.

    A null text is empty: its end id alone.  Very long texts are encoded whole
    and cut into as many chunks as it takes.  Rows that share a doc_id stand
    next to each other, each with a recipe of its own.  An empty table gives
    an empty one.
    """
    spark = docs.sparkSession
    path = path or new_path(spark, "token-store")
    write_store(docs, path, tokenizer, end_id)
    release_shuffles(spark)
    verify_manifest(spark, path)
    return write_and_read(document_checksums(spark, path), new_path(spark, "token-sums"))
