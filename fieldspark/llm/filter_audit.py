"""How five document filters interact, over every order in which they could be applied.

Whole texts are scanned where Arrow holds them: byte classes by table lookup
and prefix sums over the buffer of a batch give each document's words,
capitals, symbols and code points without a Python string.  Distinct words are
the distinct hashes of a document's words in sorted order, where neighbours of
one hash have been compared byte by byte.  Each document then is a mask of the
filters that it fails, and all orders are sums over the counts of masks: a
hot part is a few dozen rows before anything is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import Scratch, new_path, scratched, small_side, write_and_read

FILTERS = "ABCDE"
FEWEST_WORDS, DISTINCT_PERCENT, CAPITAL_PERCENT = 50, 65, 5
SYMBOLS = b"#$%&*|"
#: Bytes of text that are scanned at once; a longer text is scanned alone.
SLICE_BYTES = 1 << 21

_space, _capital, _symbol, _inner = (np.zeros(256, bool) for _ in range(4))
_space[[0x20, *range(0x09, 0x0E)]] = True
_capital[ord("A") : ord("Z") + 1] = True
_symbol[list(SYMBOLS)] = True
_inner[0x80:0xC0] = True  # all bytes of a code point but its first


def _per_text(flags: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """How many flags lie in each text: differences of a prefix sum at the texts' edges."""
    before = np.zeros(len(flags) + 1, np.int32)
    np.cumsum(flags, out=before[1:])
    return np.diff(before[edges].astype(np.int64))


def word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word: the sum of its bytes, each mixed with its place in the word, by prefix sums over parts of the buffer."""
    out = np.zeros(len(start), np.uint64)
    for lo in range(0, len(data), SLICE_BYTES):
        a, b = np.searchsorted(end, lo, side="right"), np.searchsorted(start, lo + SLICE_BYTES)
        if a == b:
            continue
        s, e = np.maximum(start[a:b], lo), np.minimum(end[a:b], lo + SLICE_BYTES)
        size = e - s
        before = np.concatenate([[0], np.cumsum(size)])
        at = np.arange(before[-1]) + np.repeat(s - before[:-1], size)
        place = (at - np.repeat(start[a:b], size)).astype(np.uint64)
        h = (data[at].astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        h ^= (place + np.uint64(1)) * np.uint64(0xC2B2AE3D27D4EB4F)
        h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(32)
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(h)])
        out[a:b] += sums[before[1:]] - sums[before[:-1]]
    return out


def _differing(data: np.ndarray, a: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether the words that begin at a and b, of one size each, differ in a byte."""
    out, at, ends = np.zeros(len(a), bool), 0, np.cumsum(size)
    while at < len(a):
        to = max(at + 1, int(np.searchsorted(ends, ends[at] - size[at] + SLICE_BYTES, side="right")))
        if to == at + 1:
            out[at] = not np.array_equal(data[a[at] : a[at] + size[at]], data[b[at] : b[at] + size[at]])
        else:
            owner = np.repeat(np.arange(at, to), size[at:to])
            place = np.arange(len(owner)) - (ends[owner] - size[owner] - ends[at] + size[at])
            out[owner[data[a[owner] + place] != data[b[owner] + place]]] = True
        at = to
    return out


def distinct_words(data: np.ndarray, start: np.ndarray, end: np.ndarray, text: np.ndarray, n: int, hashes=word_hashes) -> np.ndarray:
    """Distinct words of each of n texts; text names that of each word."""
    h, size = hashes(data, start, end), end - start
    order = np.lexsort((size, h, text))
    a, b = order[:-1], order[1:]
    alike = (h[a] == h[b]) & (text[a] == text[b])
    same = alike & (size[a] == size[b])
    pair = np.flatnonzero(same)
    same[pair[_differing(data, start[a[pair]], start[b[pair]], size[a[pair]])]] = False
    out = np.bincount(text, minlength=n) - np.bincount(text[b[same]], minlength=n)
    for t in np.unique(text[b[alike & ~same]]):  # two words of one hash: such a text is counted by its words themselves
        own = np.flatnonzero(text == t)
        out[t] = len({data[s:e].tobytes() for s, e in zip(start[own], end[own], strict=True)})
    return out


def measures(data: np.ndarray, edges: np.ndarray) -> dict[str, np.ndarray]:
    """words, distinct, capitals, symbols, points of the texts that lie one after the other in data, between edges."""
    n = len(edges) - 1
    inside = ~_space[data]
    opens = np.zeros(len(data), bool)
    opens[edges[:-1][edges[:-1] < len(data)]] = True  # no word goes over the edge of a text
    before = np.concatenate([[False], inside[:-1]])
    start = np.flatnonzero(inside & (opens | ~before))
    after = np.concatenate([inside[1:], [False]])
    closes = np.concatenate([opens[1:], [True]]) if len(data) else opens
    end = np.flatnonzero(inside & (closes | ~after)) + 1
    text = np.searchsorted(edges, start, side="right") - 1
    return {
        "words": np.bincount(text, minlength=n),
        "distinct": distinct_words(data, start, end, text, n),
        "capitals": _per_text(_capital[data], edges),
        "symbols": _per_text(_symbol[data], edges),
        "points": np.diff(edges) - _per_text(_inner[data], edges),
    }


def failed(m: dict[str, np.ndarray]) -> np.ndarray:
    """A bit for each of the first four filters, A lowest, that a text fails."""
    few = m["words"] < FEWEST_WORDS
    repeats = 100 * m["distinct"] < DISTINCT_PERCENT * m["words"]
    shouts = 100 * m["capitals"] > CAPITAL_PERCENT * m["points"]
    return few * 1 + repeats * 2 + shouts * 4 + (m["symbols"] > 0) * 8


def scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """mask in place of text; buffers are read as Arrow holds them."""
    for batch in batches:
        texts = batch.column(batch.schema.get_field_index("text")).cast(pa.large_binary())
        offsets = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1 + texts.offset)[texts.offset :]
        whole = np.frombuffer(texts.buffers()[2], np.uint8) if texts.buffers()[2] is not None else np.zeros(0, np.uint8)
        masks, at = np.zeros(len(texts), np.int32), 0
        while at < len(texts):
            to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + SLICE_BYTES, side="right")) - 1)
            masks[at:to] = failed(measures(whole[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]))
            at = to
        rest = [n for n in batch.schema.names if n != "text"]
        yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in rest], pa.array(masks)], [*rest, "mask"])


def steps() -> list[tuple]:
    """mask, filter_order, step, kept, removed, redundant, unique_fails, shapley: what one document of a mask adds to each row.

    Its size is fixed: all masks, orders and steps of five filters.
    """
    out = []
    for order in map("".join, permutations(FILTERS)):
        bits = [1 << FILTERS.index(f) for f in order]
        for mask in range(1 << len(FILTERS)):
            gone, fails = False, bin(mask).count("1")
            for k, bit in enumerate(bits):
                hit = bool(mask & bit)
                removed, redundant = hit and not gone, hit and gone
                gone = gone or hit
                # in how many of all orders this filter is the first of those failed
                share = 120 // fails if hit else 0
                out.append((mask, order, k + 1, int(not gone), int(removed), int(redundant), int(mask == bit), share))
    return out


@scratched
def filter_audit(scratch: Scratch, docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """part, filter_order, step and the counts kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley.

    One row for each part, each of the 120 orders and each of its five steps,
    zeros included.  A null text is empty, a null part the empty string; very
    long texts are scanned whole.  Filter E fails where a smaller doc_id of
    the whole table has the same text: rows that repeat a doc_id do not fail
    each other, and rows without an id neither fail nor count as smaller.
    Labels are those of the row's doc_id, good or toxic where any label row of
    the id says 1; other label values and ids without a label say neither.
    Further columns of either table, whatever their names, are left alone.  An
    empty table has no part and gives no row.
    """
    spark = docs.sparkSession
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"),
        F.sha2(F.coalesce(F.col(text_col), F.lit("")).cast("binary"), 256).alias("digest"),
        F.coalesce(F.col(text_col), F.lit("")).alias("text"),
    )
    rows = scratch.table(rows.mapInArrow(scanned, "doc_id long, part string, digest string, mask int"), "masks")
    # a text that only one row has cannot be a copy; of the others, only what the rows of a text share is moved
    texts = rows.groupBy("digest").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last")
    copied = small_side(scratch.table(texts.select("digest", "first"), "copied"))
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), *[F.coalesce(F.col(c).cast("int") == 1, F.lit(False)).cast("int").alias(c) for c in ("quality", "toxic")])
    known = known.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("quality").alias("good"), F.max("toxic").alias("toxic")).where("good + toxic > 0")
    told = rows.join(copied, "digest", "left").join(known, "doc_id", "left")
    mask = F.col("mask") + F.when(F.col("first") < F.col("doc_id"), 1 << FILTERS.index("E")).otherwise(0)
    counts = told.groupBy("part", mask.alias("mask")).agg(
        F.count("*").alias("n"), F.sum(F.coalesce("good", F.lit(0))).alias("good"), F.sum(F.coalesce("toxic", F.lit(0))).alias("toxic")
    )
    table = spark.createDataFrame(steps(), "mask int, filter_order string, step int, kept int, removed int, redundant int, unique_fails int, shapley int")
    each = scratch.table(counts, "counts").join(F.broadcast(table), "mask")  # a fixed table of 19,200 rows
    sums = {c: F.col(c) * F.col("n") for c in ("kept", "removed", "redundant", "unique_fails", "shapley")}
    sums |= {"good_lost": F.col("removed") * F.col("good"), "toxic_lost": F.col("removed") * F.col("toxic")}
    out = each.groupBy("part", "filter_order", "step").agg(*[F.sum(c).cast("long").alias(n) for n, c in sums.items()])
    return write_and_read(out, new_path(spark, "audit"))
