"""Packing of documents into training sequences by order-preserving dynamic programming.

The documents of a partition, in their order, are one stream of ids.  Windows
end at the ends of documents or sentences (inside a sentence of more than
``STRIDE`` ids, also at every STRIDE-th id).  Of all ways to cut the stream
into windows of at most ``length`` ids, the one with the least padding plus
penalties for documents and sentences that a cut splits is found by

    best[j] = penalty[j] + min over i < j, at[j] - at[i] <= length of
              best[i] + length - (at[j] - at[i])

The inner minimum is over best[i] + at[i] in a sliding range of i, which a
monotone queue holds, so the work grows with the number of cut points.
No document is moved between partitions: nothing is shuffled.
"""

from __future__ import annotations

import zlib
from array import array
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .storage import Scratch, give_back, new_path, write_and_read
from .tokens import ChunkEncoder, ascending

#: What a cut costs, in ids of padding: at the end of a document, of a sentence, elsewhere.
END_OF_DOCUMENT, END_OF_SENTENCE, ELSEWHERE = 0.0, 1.0, 4.0
#: Distance of the cut points inside long sentences.
STRIDE = 16
#: Ids that one run of the dynamic programme takes at once.
STREAM = 2_000_000
#: Cut points that are Python numbers at once.
LISTED = 20_000


def best_cuts(at: np.ndarray, penalty: np.ndarray, length: int) -> np.ndarray:
    """Indices of the cut points chosen among the ascending positions at, which start with 0.

    The last one is always chosen.  Neighbours are at most length apart.
    """
    n = len(at)
    back = array("i", [0])
    queue: deque[tuple[float, int, int]] = deque([(0.0, 0, 0)])
    for first in range(1, n, LISTED):
        beyond = min(n, first + LISTED)
        for j, place, cost in zip(range(first, beyond), at[first:beyond].tolist(), penalty[first:beyond].tolist(), strict=True):
            low = place - length
            while queue[0][2] < low:
                queue.popleft()
            least, i, _ = queue[0]
            back.append(i)
            key = (least + length - place + cost) + place
            while queue and queue[-1][0] >= key:  # of equals the later start: fuller first windows are kept by order
                queue.pop()
            queue.append((key, j, place))
    out, j = [n - 1], n - 1
    while j:
        j = back[j]
        out.append(j)
    return np.array(out[::-1])


def cut_points(sentence_ends: np.ndarray, doc_ends: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions and penalties of the cut points of documents that follow one another."""
    points = ascending(sentence_ends, doc_ends)
    gaps = np.diff(points, prepend=0)
    stride = min(STRIDE, length)
    # inside a gap of g ids lie ceil(g / stride) - 1 further points
    inside = (gaps - 1) // stride
    rank = np.arange(int(inside.sum())) - np.repeat(np.cumsum(inside) - inside, inside)
    within = np.repeat(points - gaps, inside) + stride * (rank + 1)
    both = np.concatenate([points, within])
    cost = np.concatenate([np.where(np.isin(points, doc_ends), END_OF_DOCUMENT, END_OF_SENTENCE), np.full(len(within), ELSEWHERE)])
    order = np.argsort(both)
    return both[order], cost[order]


class Stream:
    """The ids of a partition so far, and where they may be cut."""

    def __init__(self, length: int):
        self.length, self.sequence = length, 0
        self.docs: list[tuple[object, int, int, int]] = []  # doc_id, first id's place in the stream, start in the document, ids of the document
        self.ids: list[np.ndarray] = []
        self.at: list[np.ndarray] = [np.zeros(1, np.int64)]
        self.cost: list[np.ndarray] = [np.zeros(1)]
        self.n = 0

    def add(self, doc_ids: list, ids: np.ndarray, doc_ends: np.ndarray, points: np.ndarray, cost: np.ndarray) -> None:
        """Adds documents whose ids end at doc_ends, none of them without ids."""
        starts = np.append(0, doc_ends[:-1])
        self.docs += zip(doc_ids, (starts + self.n).tolist(), [0] * len(doc_ids), (doc_ends - starts).tolist(), strict=True)
        self.ids.append(ids)
        self.at.append(points + self.n)
        self.cost.append(cost)
        self.n += len(ids)

    def pack(self, last: bool) -> list[tuple]:
        """Pieces of all sequences; unless last, the ids after the last cut but one stay in the stream."""
        if not self.n:
            return []
        at, ids = np.concatenate(self.at), np.concatenate(self.ids)
        cost = np.concatenate(self.cost)
        cuts = at[best_cuts(at, cost, self.length)]
        until = len(cuts) if last else max(1, len(cuts) - 1)
        out = []
        first = np.array([d[1] for d in self.docs])
        for a, b in zip(cuts[: until - 1].tolist(), cuts[1:until].tolist(), strict=True):
            k = int(np.searchsorted(first, a, side="right")) - 1
            place = a
            while place < b:
                doc_id, begin, start, total = self.docs[k]
                stop = min(b, self.docs[k + 1][1] if k + 1 < len(self.docs) else self.n)
                crc = zlib.crc32(ids[place:stop].astype("<u4").tobytes())
                out.append((doc_id, start + place - begin, stop - place, crc, total, self.sequence, place - a))
                place, k = stop, k + 1
            self.sequence += 1
        done = int(cuts[until - 1])
        if done < self.n:
            k = int(np.searchsorted(first, done, side="right")) - 1
            doc_id, begin, start, total = self.docs[k]
            self.docs = [(doc_id, 0, start + done - begin, total), *((i, p - done, s, t) for i, p, s, t in self.docs[k + 1 :])]
            keep = at > done
            self.at, self.cost = [np.zeros(1, np.int64), at[keep] - done], [np.zeros(1), cost[keep]]
            self.ids, self.n = [ids[done:]], self.n - done
        else:
            self.docs, self.ids, self.n = [], [], 0
            self.at, self.cost = [np.zeros(1, np.int64)], [np.zeros(1)]
        return out


PIECES = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "local", "offset"]


def pack(docs: DataFrame, tokenizer: str, end_id: int, length: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A document's ids are those of its whole text (null: none), then end_id.
    Each id lies in exactly one piece.  Documents keep the order of their
    table; sequences are numbered through, in order of partitions.  A null
    doc_id and repeated ones are packed like any other row, each as its own
    document.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()
        part, stream = TaskContext.get().partitionId(), Stream(length)
        encoder = ChunkEncoder.of(tokenizer)

        def told(pieces: list[tuple]) -> pa.RecordBatch:
            columns = [pa.array(c, pa.int64()) for c in zip(*pieces, strict=True)] if pieces else [pa.array([], pa.int64())] * len(PIECES)
            return pa.RecordBatch.from_arrays([*columns, pa.array([part] * len(pieces), pa.int32())], names=[*PIECES, "part"])

        for batch in batches:
            doc_ids = batch.column("doc_id").to_pylist()
            for first, beyond, e in encoder.encode(batch.column("text")):
                # the end id stays with the last sentence
                sentences = e.chunk_ends[e.sentences() & (e.chunk_ends > 0) & ~np.isin(e.chunk_ends, e.ends)]
                sentences = sentences + np.searchsorted(e.ends, sentences)
                ends = e.ends + np.arange(1, len(e.ends) + 1)
                ids = np.insert(e.ids, e.ends, np.uint32(end_id))
                stream.add(doc_ids[first:beyond], ids, ends, *cut_points(sentences, ends, length))
                if stream.n >= STREAM:
                    yield told(stream.pack(last=False))
        yield told(stream.pack(last=True))

    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, local long, offset long, part int"
    pieces = scratch.table(rows.mapInArrow(run, schema), "pieces")
    sizes = pieces.groupBy("part").agg((F.max("local") + 1).alias("own"))
    # one row for each partition of the input
    base = sizes.select("part", (F.sum("own").over(Window.orderBy("part")) - F.col("own")).alias("base"))
    out = pieces.join(F.broadcast(base), "part").select(*PIECES[:5], (F.col("base") + F.col("local")).alias("sequence_id"), "offset")
    out = write_and_read(out, new_path(spark, "packed"))
    scratch.clear()
    return out
