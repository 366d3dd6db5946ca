"""Quality by a factorisation machine over hashed words, structure statistics and metadata.

A document is a sparse vector: its distinct words, hashed, with a unit norm
together, and one feature for the bin of each statistic of its structure and
each metadata column.  The machine adds to a linear score an interaction for
every pair of features, the product of their low-rank vectors; the sum over
all pairs is half of (sum of vectors) squared less the sum of squares, so a
score costs time linear in the features.

It is trained where the labelled rows are: they are dealt into PARTS by a
hash, each round every part goes once over its rows from the shared weights,
and the weights that come back are averaged.  Rows of one fold fit the
logistic curve that turns margins into shares of good documents.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import Scratch, scratched
from .toxicity import fit_curve, fold

WORD = re.compile(r"[^\x20\x09-\x0D]+")
#: Buckets of words and of bins, and the rank of the interactions.
WORD_BUCKETS, BIN_BUCKETS, RANK = 1 << 16, 1 << 12, 8
PARTS, ROUNDS, BATCH = 6, 10, 64
RATE, DECAY = 0.1, 1e-5
#: Bins of a share from 0 to 1: finer near 0, where texts differ most.
SHARES = np.array([0.001, 0.003, 0.01, 0.02, 0.04, 0.07, 0.12, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 0.97])


class _Buckets(dict):
    """Buckets of words, remembered up to a bound."""

    def __missing__(self, word: str) -> int:
        if len(self) > 500_000:
            self.clear()
        bucket = self[word] = xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass")) % WORD_BUCKETS
        return bucket


_buckets = _Buckets()


def statistics(text: str, words: list[str]) -> dict[str, float]:
    """Shares of a text's structure, 0 to 1; all 0 for an empty text."""
    n, many = max(len(text), 1), max(len(words), 1)
    counts = Counter(words)
    lines = [line for line in text.split("\n") if line.strip()]
    each = max(len(lines), 1)
    ends = sum(w[-1] in ".,;:!?" for w in words)
    return {
        "distinct": len(counts) / many,
        "commonest": max(counts.values(), default=0) / many,
        "capitals": sum(map(text.count, "ABCDEFGHIJKLMNOPQRSTUVWXYZ")) / n,
        "digits": sum(map(text.count, "0123456789")) / n,
        "symbols": sum(map(text.count, "#$%&*|<>{}[]=_~^@\\/+")) / n,
        "exclaims": text.count("!") / n,
        "ends": ends / many,
        "stops": text.count(".") / many,
        "short": sum(len(w) <= 3 for w in words) / many,
        "long": sum(len(w) > 12 for w in words) / many,
        "letters": sum(map(str.isalpha, text)) / n,
        "lines": len(lines) / many,
        "repeated_lines": 1 - len(set(lines)) / each,
    }


def _bin(name: str, value: object) -> int:
    return WORD_BUCKETS + xxhash.xxh64_intdigest(f"{name}={value}".encode()) % BIN_BUCKETS


def features(text: str | None, metadata: dict[str, object]) -> tuple[np.ndarray, np.ndarray]:
    """Indexes and values of a document: its words share a unit norm, every bin counts one half."""
    text = text or ""
    words = WORD.findall(text)
    own = np.unique(np.fromiter(map(_buckets.__getitem__, words), np.int32, len(words)))
    bins = [_bin(name, int(np.searchsorted(SHARES, value))) for name, value in statistics(text, words).items()]
    bins.append(_bin("words", len(words).bit_length()))
    for name, value in metadata.items():
        missing = value is None or isinstance(value, float) and not np.isfinite(value)
        kind = "-" if missing else value if isinstance(value, str) else int(np.log2(max(float(value), 0) + 1) * 2)
        bins.append(_bin(f"metadata {name}", kind))
    index = np.concatenate([own, np.array(bins, np.int32)])
    value = np.concatenate([np.full(len(own), 1 / np.sqrt(max(len(own), 1)), np.float32), np.full(len(bins), 0.5, np.float32)])
    return index, value


@dataclass
class Machine:
    """Weights: the constant, one and a vector for each feature; with them the sums of squared gradients that set the step."""

    constant: np.ndarray
    linear: np.ndarray
    vectors: np.ndarray
    seen: np.ndarray

    @staticmethod
    def new() -> Machine:
        size = WORD_BUCKETS + BIN_BUCKETS
        vectors = np.random.default_rng(11).normal(0, 0.02, (size, RANK)).astype(np.float32)
        return Machine(np.zeros(2, np.float32), np.zeros(size, np.float32), vectors, np.full((size, RANK + 1), 1e-2, np.float32))

    def margins(self, index: np.ndarray, value: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The score of each row before the curve, and its sum of vectors; rows are runs of index that begin at starts, none empty."""
        scaled = self.vectors[index] * value[:, None]
        summed = np.add.reduceat(scaled, starts)
        squares = np.add.reduceat(scaled * scaled, starts).sum(1)
        linear = np.add.reduceat(self.linear[index] * value, starts)
        return self.constant[0] + linear + 0.5 * ((summed * summed).sum(1) - squares), summed

    def learn(self, index: np.ndarray, value: np.ndarray, starts: np.ndarray, good: np.ndarray) -> None:
        """One step against the gradient of the logistic loss of some rows."""
        margin, summed = self.margins(index, value, starts)
        miss = 1 / (1 + np.exp(-np.clip(margin, -30, 30))) - good
        sizes = np.diff(np.append(starts, len(index)))
        by_entry = (np.repeat(miss, sizes) * value)[:, None]
        pull = np.concatenate([by_entry, by_entry * (np.repeat(summed, sizes, axis=0) - self.vectors[index] * value[:, None])], axis=1)
        order = np.argsort(index, kind="stable")
        own, first = np.unique(index[order], return_index=True)
        gradient = np.add.reduceat(pull[order], first) / len(good)
        gradient[:, 0] += DECAY * self.linear[own]
        gradient[:, 1:] += DECAY * self.vectors[own]
        self.seen[own] += gradient * gradient
        step = RATE * gradient / np.sqrt(self.seen[own])
        self.linear[own] -= step[:, 0]
        self.vectors[own] -= step[:, 1:]
        g = float(miss.mean())
        self.constant[1] += g * g
        self.constant[0] -= RATE * g / np.sqrt(self.constant[1] + 1e-2)

    def packed(self) -> bytes:
        return b"".join(np.ascontiguousarray(a, np.float32).tobytes() for a in (self.constant, self.linear, self.vectors, self.seen))

    @staticmethod
    def unpacked(flat: np.ndarray) -> Machine:
        size = WORD_BUCKETS + BIN_BUCKETS
        constant, linear, vectors, seen = np.split(flat, np.cumsum([2, size, size * RANK]))
        return Machine(constant.copy(), linear.copy(), vectors.reshape(size, RANK).copy(), seen.reshape(size, RANK + 1).copy())


def _rows_of(frame: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    index = [np.frombuffer(x, "<i4") for x in frame["index"]]
    sizes = np.array([len(x) for x in index])
    return np.concatenate(index), np.concatenate([np.frombuffer(x, "<f4") for x in frame["value"]]), np.cumsum(sizes) - sizes


@dataclass
class Judge:
    """The machine and the curve of its margins."""

    machine: Machine
    scale: float
    shift: float

    def score(self, texts: pd.Series, metadata: list[dict[str, object]]) -> np.ndarray:
        out = np.empty(len(texts))
        for k, (text, more) in enumerate(zip(texts, metadata, strict=True)):
            index, value = features(text, more)
            out[k] = self.machine.margins(index, value, np.zeros(1, np.int64))[0][0]
        return 1 / (1 + np.exp(-np.clip(self.scale * out + self.shift, -30, 30)))


def _metadata(columns: list[pd.Series], names: tuple[str, ...]) -> list[dict[str, object]]:
    return [dict(zip(names, row, strict=True)) for row in zip(*columns, strict=True)] if names else []


def labelled(scratch: Scratch, docs: DataFrame, labels: DataFrame, max_rows: int, id_col: str, text_col: str, metadata: tuple[str, ...]) -> tuple[DataFrame, dict[int, int]]:
    """y, fold, part, index, value of the labelled documents that teach, at most max_rows of each class, and labels of each class."""
    known = labels.select(F.col("doc_id").cast("long").alias("id"), F.col("quality").cast("int").alias("y")).where("id IS NOT NULL AND y IN (0, 1)")
    known = known.where(fold(F.col("id")) != 0).groupBy("id").agg(F.min("y").alias("y"), F.max("y").alias("most")).where("y = most").drop("most")
    picked = None
    for y in (0, 1):
        some = known.where(F.col("y") == y).orderBy(F.xxhash64("id"), "id").limit(max_rows)
        picked = some if picked is None else picked.unionByName(some)
    picked = scratch.table(picked, "labels")  # 2 * max_rows rows at most
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), *[F.col(c).alias(f"metadata_{k}") for k, c in enumerate(metadata)])
    rows = rows.join(F.broadcast(picked), "id").withColumns({"fold": fold(F.col("id")), "digest": F.xxhash64("text")})
    rows = rows.dropDuplicates(["y", "digest"])

    def made(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            more = _metadata([batch[f"metadata_{k}"] for k in range(len(metadata))], metadata) or [{}] * len(batch)
            found = [features(t, m) for t, m in zip(batch["text"], more, strict=True)]
            yield pd.DataFrame({"y": batch["y"], "fold": batch["fold"], "digest": batch["digest"], "index": [i.astype("<i4").tobytes() for i, _ in found], "value": [v.astype("<f4").tobytes() for _, v in found]})

    rows = scratch.table(rows.mapInPandas(made, "y int, fold long, digest long, index binary, value binary"), "features")
    # an id may have several texts: the bound holds for rows as well
    few = [rows.where(F.col("y") == y).orderBy("digest").limit(max_rows) for y in (0, 1)]
    rows = few[0].unionByName(few[1]).withColumn("part", F.pmod(F.xxhash64(F.lit(3), "digest"), F.lit(PARTS)).cast("int"))
    return scratch.table(rows.repartition(PARTS, "part"), "labelled"), {r.y: r["count"] for r in known.groupBy("y").count().collect()}


def averaged(machine: Machine, told: list) -> Machine:
    """The mean of the machines of the parts, by their rows; told: constant, at, weights (what changed, and to what) and n of each part."""
    before = np.column_stack([machine.linear, machine.vectors, machine.seen])
    constant, after, every = np.zeros(2, np.float32), before.copy(), sum(r["n"] for r in told)
    for r in told:
        share, at = np.float32(r["n"] / every), np.frombuffer(r["at"], "<i4")
        constant += share * np.frombuffer(r["constant"], "<f4")
        after[at] += share * (np.frombuffer(r["weights"], "<f4").reshape(len(at), -1) - before[at])
    return Machine(constant, *(np.ascontiguousarray(a) for a in (after[:, 0], after[:, 1 : RANK + 1], after[:, RANK + 1 :])))


def _once(shared: Broadcast, seed: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """One pass over the rows of a part, from the shared weights: the features whose weights it has changed, and these."""

    def work(frame: pd.DataFrame) -> pd.DataFrame:
        own = Machine.unpacked(np.frombuffer(shared.value, np.float32))
        frame = frame.sort_values("digest").sample(frac=1, random_state=seed)
        for at in range(0, len(frame), BATCH):
            some = frame.iloc[at : at + BATCH]
            own.learn(*_rows_of(some), some["y"].to_numpy(np.float32))
        first = Machine.unpacked(np.frombuffer(shared.value, np.float32))
        at = np.flatnonzero((own.linear != first.linear) | (own.vectors != first.vectors).any(1) | (own.seen != first.seen).any(1)).astype("<i4")
        weights = np.column_stack([own.linear[at], own.vectors[at], own.seen[at]]).astype("<f4")
        return pd.DataFrame({"constant": [own.constant.astype("<f4").tobytes()], "at": [at.tobytes()], "weights": [weights.tobytes()], "n": [len(frame)]})

    return work


@scratched
def train(scratch: Scratch, docs: DataFrame, labels: DataFrame, max_rows: int = 20_000, id_col: str = "doc_id", text_col: str = "text", metadata: tuple[str, ...] = ("n_chars",)) -> Judge:
    """Learns from labelled rows with crc32(doc_id as text) mod 5 not 0.

    At most max_rows labelled documents of each class are used, those with
    the least hash of their id; folds 1 to 3 train the machine, fold 4 fits
    the curve.  Labels other than 0 and 1, and documents labelled both ways, teach nothing.
    """
    spark = docs.sparkSession
    rows, shares = labelled(scratch, docs, labels, max_rows, id_col, text_col, metadata)
    machine = Machine.new()
    for round_ in range(ROUNDS):
        shared = spark.sparkContext.broadcast(machine.packed())

        # a part holds a PARTS-th of 2 * max_rows rows; what comes back of it are the weights of its own words
        told = rows.where("fold <> 4").groupBy("part").applyInPandas(_once(shared, round_), "constant binary, at binary, weights binary, n long").collect()
        shared.destroy()
        if not told:
            break
        told = sorted(told, key=lambda r: r.weights)  # one order of summing
        machine = averaged(machine, told)
    shared = spark.sparkContext.broadcast(machine)

    def margins(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                yield pd.DataFrame({"y": b["y"], "x": shared.value.margins(*_rows_of(b))[0].astype(float)})

    held = rows.where("fold = 4").select("y", "index", "value").mapInPandas(margins, "y int, x double").orderBy("y", "x").toPandas()
    shared.destroy()
    y, x = held["y"].to_numpy(), held["x"].to_numpy(float)
    if len(y) == 0 or y.min() == y.max():
        return Judge(machine, 1.0, 0.0)
    scale, shift, _ = fit_curve(x, y)
    # the bounded sample takes the classes alike; the curve is for their shares among the labels
    used = {c: min(n, max_rows) for c, n in shares.items()}
    shift += float(np.log(shares[1] / shares[0]) - np.log(used[1] / used[0]))
    return Judge(machine, scale, shift)


def quality(docs: DataFrame, labels: DataFrame, max_rows: int = 20_000, id_col: str = "doc_id", text_col: str = "text", metadata: tuple[str, ...] = ("n_chars",), threshold: float = 0.3) -> DataFrame:
    """One row for each row of docs: doc_id, held_out, score, predicted.

    score is the share of good documents among those alike; predicted is 1
    from the threshold on.  metadata names columns of docs: numbers count by
    size, strings by value, null is a value of its own.  Null and empty texts
    have no words and the statistics of an empty text; a very long text is
    scored whole.  A null doc_id is not held out.  Repeated rows score alike.
    Without labels of both classes the score is near one half; an empty table gives an empty one.
    """
    judge = docs.sparkSession.sparkContext.broadcast(train(docs, labels, max_rows, id_col, text_col, metadata))

    @F.pandas_udf("double")
    def score(texts: pd.Series, more: pd.DataFrame) -> pd.Series:
        return pd.Series(judge.value.score(texts, _metadata([more[c] for c in more.columns if c != "none"], metadata) or [{}] * len(texts)))

    more = F.struct(*[F.col(c).alias(f"metadata_{k}") for k, c in enumerate(metadata)]) if metadata else F.struct(F.lit(None).cast("int").alias("none"))
    out = docs.select(F.col(id_col).cast("long").alias("doc_id"), score(F.col(text_col), more).alias("score"))
    out = out.select("doc_id", F.coalesce(fold(F.col("doc_id")) == 0, F.lit(False)).alias("held_out"), "score")
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
