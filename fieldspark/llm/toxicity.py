"""Toxicity by class-conditional Kneser-Ney bigram models.

Two models are counted, on toxic and on ordinary labelled documents, by
Kneser-Ney's continuation counts: an expression counts once for each different
word that it follows, at its first place in a document.  So neither a long
document nor a crowd of copies makes an expression frequent.  Both models take a discount off every count and
give what it frees to the lower order: from bigrams to words of their class,
and from there to the share of the word among the words of all documents,
labelled or not.  An expression too rare to tell the classes apart so has the
same backoff counts in both, and says next to nothing.

A discount is a step: of an expression that both classes hold about equally
often, one count may lie just above it and the other just below, and the ratio
is then that of a count and a backoff, a thousandfold.  The more documents, the
more such expressions.  No two discounts have their step at the same count, so
models of several strengths are asked, and a word says what all of them say.

The score compares the two likelihoods, word by word as P(toxic) / P(ordinary),
normalised by the text's length: the logarithm of the ratios' power mean.  Its
order is 0 for the plain difference of mean log-likelihoods; higher orders give
more to a few strong words in a long text.  Discounts are those that counts of
counts estimate, times a strength.  Strengths, the models that have to agree
and the order are the ones of least logistic loss on fold 4, which the counts
have not seen; the logistic curve fitted there turns the comparison into 0 to 1.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import Scratch, partitions, scratched, small_side

WORD = re.compile(r"[^\W\d_]+")
#: Times the estimated discounts, of bigrams and of words: what fold 4 chooses among.  All leave nothing of a single
#: document's words, so that models only hold expressions that several documents share.
STRENGTHS = ((2.0, 2.0), (4.0, 2.0), (8.0, 2.0), (4.0, 4.0))
#: Which of these models have to agree on a word: one alone, all discounts of bigrams, all; what fold 4 chooses among.
AGREEING = ((0,), (1,), (2,), (3,), (0, 1, 2), (0, 1, 2, 3))
#: Orders of the power mean that fold 4 chooses among.
ORDERS = (0, 1, 2, 4)
START = np.uint64(0)  # the word before the first


class _Keys(dict):
    """64-bit hashes of words, remembered up to a bound."""

    def __missing__(self, word: str) -> int:
        if len(self) >= 100_000:  # some 20 MB, in every worker that an executor has
            self.clear()
        key = self[word] = xxhash.xxh64_intdigest(word.encode()) | 1  # never START
        return key


_keys = _Keys()


def word_keys(text: str | None) -> np.ndarray:
    words = WORD.findall((text or "").lower())
    return np.fromiter(map(_keys.__getitem__, words), np.uint64, len(words))


def pair_key(v: np.ndarray, w: np.ndarray) -> np.ndarray:
    h = (v * np.uint64(0x9E3779B97F4A7C15)) ^ (w * np.uint64(0xC2B2AE3D27D4EB4F))
    return (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)


def discount(counts_of_counts: list[int]) -> float:
    """What is taken off a count of three and more, from how many expressions occur 1, 2, 3 and 4 times; 1 to 3."""
    n1, n2, n3, n4 = (max(1, n) for n in counts_of_counts)
    return float(np.clip(3 - 4 * n1 / (n1 + 2 * n2) * n4 / n3, 1.0, 3.0))


def find(sorted_keys: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Places of keys in sorted_keys; beyond the last where they are not."""
    at = np.searchsorted(sorted_keys, keys)
    there = at < len(sorted_keys)
    there[there] = sorted_keys[at[there]] == keys[there]
    return np.where(there, at, len(sorted_keys))


@dataclass
class KneserNey:
    """Both models with discounts of one strength; in pairs, index 1 is toxic.  The last entry stands for all others."""

    words: np.ndarray  # ascending keys
    low: list[np.ndarray]  # likelihood of each word after an unknown one
    contexts: np.ndarray  # ascending keys of words that others follow
    weight: list[np.ndarray]  # what the lower order gets after each of them
    pairs: np.ndarray  # ascending keys of bigrams
    counted: list[np.ndarray]  # what their own counts give them

    def places(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Where a text's words, the words before them and their bigrams are; the same in models of other strengths."""
        before = np.concatenate([[START], keys[:-1]]) if len(keys) else keys
        return find(self.words, keys), find(self.contexts, before), find(self.pairs, pair_key(before, keys))

    def ratios_at(self, w: np.ndarray, v: np.ndarray, p: np.ndarray) -> np.ndarray:
        both = [self.counted[c][p] + self.weight[c][v] * self.low[c][w] for c in (0, 1)]
        return np.log(both[1]) - np.log(both[0])

    def ratios(self, keys: np.ndarray) -> np.ndarray:
        """Toxic less ordinary log-likelihood of every word of a text."""
        return self.ratios_at(*self.places(keys))


def agreed(ratios: list[np.ndarray]) -> np.ndarray:
    """Of each word's log ratios the one nearest to 0; 0 where they differ in sign."""
    return np.clip(0.0, np.min(ratios, 0), np.max(ratios, 0))


def model_of(words: pd.DataFrame, contexts: pd.DataFrame, pairs: pd.DataFrame, totals: list[float], freed: list[float], off: tuple[float, float]) -> KneserNey:
    """words: key, u0, u1 (words before it, by class), share (among all documents' words); totals: u0 and u1 of all words;
    freed: what the discount takes of them.  contexts: key, t0, t1 (their bigrams), f0, f1 (what the
    discount takes of them).  pairs: key, v, n0, n1.  off: the discounts of bigrams and words.
    """
    words, contexts, pairs = (t.sort_values("key").reset_index(drop=True) for t in (words, contexts, pairs))
    rest = 1e-9  # a word that neither class holds: its share is the same on both sides, whatever it is
    low, weight, counted = [], [], []
    place = find(contexts["key"].to_numpy(), pairs["v"].to_numpy())
    for c in "01":
        total, backoff = max(totals[int(c)], 1.0), freed[int(c)] / max(totals[int(c)], 1.0) or 1.0
        own = np.maximum(words[f"u{c}"].to_numpy() - off[1], 0) / total + backoff * words["share"].to_numpy()
        low.append(np.append(own, backoff * rest))
        t = contexts[f"t{c}"].to_numpy()
        weight.append(np.append(np.where(t > 0, contexts[f"f{c}"].to_numpy() / np.maximum(t, 1), 1.0), 1.0))
        counted.append(np.append(np.maximum(pairs[f"n{c}"].to_numpy() - off[0], 0) / np.maximum(np.append(t, 1)[place], 1), 0.0))
    return KneserNey(words["key"].to_numpy(), low, contexts["key"].to_numpy(), weight, pairs["key"].to_numpy(), counted)


def power_means(ratios: np.ndarray, orders: tuple[int, ...] = ORDERS) -> list[float]:
    """The logarithm of the power mean of exp(ratios), for each order; 0 for a text without words."""
    if not len(ratios):
        return [0.0] * len(orders)
    top = float(ratios.max())
    return [float(ratios.mean()) if p == 0 else top + float(np.log(np.exp(p * (ratios - top)).mean())) / p for p in orders]


@dataclass
class Judge:
    """The models, which have to agree, and the curve that fold 4 has chosen."""

    models: list[KneserNey]
    order: int
    scale: float
    shift: float

    @property
    def model(self) -> KneserNey:
        return self.models[0]

    def ratios(self, keys: np.ndarray) -> np.ndarray:
        at = self.model.places(keys)
        return agreed([m.ratios_at(*at) for m in self.models])

    def margin(self, text: str | None) -> float:
        return power_means(self.ratios(word_keys(text)), (self.order,))[0]

    def score(self, margin: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.scale * margin + self.shift, -30, 30)))


def fit_curve(x: np.ndarray, y: np.ndarray, rounds: int = 60) -> tuple[float, float, float]:
    """Scale and shift of a logistic curve by Newton steps, with a weak pull to 0, and its mean loss; the scale is never negative."""
    if len(x) == 0 or y.min() == y.max():
        return 50.0, -50.0, np.inf
    unit = x.std() or 1.0
    z = np.stack([x / unit, np.ones(len(x))], 1)
    beta = np.zeros(2)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ beta, -30, 30)))
        grad = z.T @ (y - p) - 1e-2 * beta
        hess = (z * (p * (1 - p))[:, None]).T @ z + 1e-2 * np.eye(2)
        step = np.linalg.solve(hess, grad)
        beta += np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    p = 1 / (1 + np.exp(-np.clip(z @ beta, -30, 30)))
    loss = -np.mean(np.log(np.clip(np.where(y == 1, p, 1 - p), 1e-12, 1)))
    return max(0.0, float(beta[0] / unit)), float(beta[1]), float(loss)


def fold(doc_id) -> F.Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 5


def labelled(scratch: Scratch, docs: DataFrame, labels: DataFrame, max_rows: int, id_col: str, text_col: str) -> tuple[DataFrame, dict[int, int]]:
    """id, text, y, fold of the labelled documents that teach, one row for each text and label; rows of each label."""
    known = labels.select(F.col("doc_id").cast("long").alias("id"), F.col("toxic").cast("int").alias("y")).where("id IS NOT NULL AND y IN (0, 1)")
    known = known.where(fold(F.col("id")) != 0).groupBy("id").agg(F.min("y").alias("y"), F.max("y").alias("most")).where("y = most").drop("most")
    picked = None
    for y in (0, 1):
        some = known.where(F.col("y") == y).orderBy(F.xxhash64("id"), "id").limit(max_rows)
        picked = some if picked is None else picked.unionByName(some)
    picked = scratch.table(picked, "labels")  # 2 * max_rows rows at most
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.join(F.broadcast(picked), "id").withColumn("fold", fold(F.col("id")))
    rows = rows.withColumn("counts", F.col("fold") != 4).dropDuplicates(["counts", "y", "text"])
    return scratch.table(rows, "labelled"), {r.y: r["count"] for r in known.groupBy("y").count().collect()}


@scratched
def train(scratch: Scratch, docs: DataFrame, labels: DataFrame, max_rows: int = 10_000, id_col: str = "doc_id", text_col: str = "text") -> Judge:
    """Learns from labelled rows with crc32(doc_id as text) mod 5 not 0; shared backoff counts come from all rows of docs.

    At most max_rows labelled documents of each class are used, those with
    the least hash of their id; folds 1 to 3 are counted, fold 4 chooses
    among STRENGTHS, AGREEING and ORDERS and fits the curve.  Labels other than 0 and
    1, and documents that are labelled both ways, teach nothing.  The models
    hold words and bigrams exactly, but for those whose counts the discounts
    use up: what these say does not depend on which they are.
    """
    rows, shares = labelled(scratch, docs, labels, max_rows, id_col, text_col)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            made = []
            for text, label in zip(batch["text"], batch["y"], strict=True):
                keys = word_keys(text)
                if len(keys):
                    before = np.concatenate([[START, START], keys[:-1]])
                    first, one = np.unique(pair_key(before[1:], keys), return_index=True)[1], np.unique(keys, return_index=True)[1]
                    made.append((before[first], before[1:][first], keys[first], np.full(len(first), 2 + label)))
                    made.append((before[1:][one], np.zeros(len(one), np.uint64), keys[one], np.full(len(one), label)))
            if made:
                x, v, w, y = map(np.concatenate, zip(*made, strict=True))
                yield pd.DataFrame({"x": x.view(np.int64), "v": v.view(np.int64), "w": w.view(np.int64), "y": y})

    each = rows.where("counts").select("text", "y").mapInPandas(count, "x long, v long, w long, y int")
    # dealt once by what is counted: the rows of an expression are told apart and counted where they are
    each = each.repartition(partitions(docs.sparkSession), "v", "w").distinct()
    sums = [F.sum((F.col("y") % 2 == c).cast("long")).alias(f"n{c}") for c in (0, 1)]
    counts = scratch.table(each.groupBy("v", "w", (F.col("y") >= 2).alias("pair")).agg(*sums), "counts")
    often = counts.groupBy("pair").agg(*[F.count_if(F.col(f"n{c}") == k).alias(f"c{c}{k}") for c in (0, 1) for k in (1, 2, 3, 4)]).collect()
    often = {r.pair: [[r[f"c{c}{k}"] for k in (1, 2, 3, 4)] for c in (0, 1)] for r in often}
    base = [float(np.mean([discount(x) for x in often.get(pair, [[1, 1, 1, 1]])])) for pair in (True, False)]
    offs = [(s * base[0], t * base[1]) for s, t in STRENGTHS]
    least = [min(o[k] for o in offs) for k in (0, 1)]
    taken = [F.sum(F.least(F.col(f"n{c}").cast("double"), F.lit(o))).alias(f"f{c}_{i}") for i, o in enumerate(o for o, _ in offs) for c in (0, 1)]
    whole = [F.sum(f"n{c}").alias(f"t{c}") for c in (0, 1)]
    bigrams, singles = counts.where("pair"), counts.where("NOT pair")
    pairs = bigrams.where(F.greatest("n0", "n1") > least[0]).select("v", "w", "n0", "n1").toPandas()
    open_words = scratch.table(bigrams.where(F.greatest("n0", "n1") > least[0]).select("v").distinct(), "contexts")
    kept = bigrams.join(small_side(open_words), "v", "left_semi")
    contexts = kept.groupBy(F.col("v").alias("key")).agg(*whole, *taken).toPandas()
    words = singles.where(F.greatest("n0", "n1") > min(least)).select(F.col("w").alias("key"), F.col("n0").alias("u0"), F.col("n1").alias("u1")).toPandas()
    totals = singles.agg(*whole, *[F.sum(F.least(F.col(f"n{c}").cast("double"), F.lit(o[1]))).alias(f"g{c}_{i}") for i, o in enumerate(offs) for c in (0, 1)]).first()
    for table in (pairs, contexts, words):
        for name in {"key", "v", "w"} & set(table.columns):
            table[name] = table[name].to_numpy(np.int64).view(np.uint64)
    pairs["key"] = pair_key(pairs["v"].to_numpy(), pairs["w"].to_numpy())
    words["share"] = _shares(docs, words["key"].to_numpy(), text_col)
    models = []
    for i, off in enumerate(offs):
        own = contexts.rename(columns={f"f{c}_{i}": f"f{c}" for c in (0, 1)})
        models.append(model_of(words, own, pairs, [float(totals[f"t{c}"] or 0) for c in (0, 1)], [float(totals[f"g{c}_{i}"] or 0) for c in (0, 1)], off))
    for m in models[1:]:  # the keys are the same and travel once
        m.words, m.contexts, m.pairs = models[0].words, models[0].contexts, models[0].pairs
    shared = docs.sparkSession.sparkContext.broadcast(models)

    def margins(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            made = []
            for text in b["text"]:
                at = shared.value[0].places(word_keys(text))
                each = [m.ratios_at(*at) for m in shared.value]
                made.append([x for some in AGREEING for x in power_means(agreed([each[i] for i in some]))])
            yield pd.DataFrame({"y": b["y"], "x": made})

    held = rows.where("NOT counts").select("text", "y").mapInPandas(margins, "y int, x array<double>").toPandas()
    y, x = held["y"].to_numpy(), np.array(held["x"].tolist(), float).reshape(len(held), len(AGREEING) * len(ORDERS))
    fits = [fit_curve(x[:, k], y) for k in range(x.shape[1])]
    best = min(range(len(fits)), key=lambda k: fits[k][2])
    scale, shift, _ = fits[best]
    # the bounded sample takes the classes alike; the curve is for their shares among the labels
    if len(shares) == 2:
        used = {c: min(n, max_rows) for c, n in shares.items()}
        shift += float(np.log(shares[1] / shares[0]) - np.log(used[1] / used[0]))
    shared.unpersist()
    return Judge([models[i] for i in AGREEING[best // len(ORDERS)]], ORDERS[best % len(ORDERS)], scale, shift)


def _shares(docs: DataFrame, keys: np.ndarray, text_col: str) -> np.ndarray:
    """For each word, its documents among the documents of all words, over all of docs; never 0."""
    order = np.argsort(keys)
    shared = docs.sparkSession.sparkContext.broadcast(keys[order])

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        wanted = shared.value
        found, every = np.zeros(len(wanted) + 1, np.int64), 0
        for batch in batches:
            for text in batch["text"]:
                one = np.unique(word_keys(text))
                every += len(one)
                found += np.bincount(find(wanted, one), minlength=len(found))
        found[-1] = every
        at = np.flatnonzero(found)
        yield pd.DataFrame({"at": at, "n": found[at]})

    told = docs.select(F.col(text_col).alias("text")).where("text IS NOT NULL").mapInPandas(count, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).toPandas()
    shared.unpersist()
    n = np.zeros(len(keys) + 1)
    n[told["at"]] = told["n"]
    out = np.empty(len(keys))
    out[order] = np.maximum(n[:-1], 0.5) / max(n[-1], 1.0)
    return out


def toxicity(docs: DataFrame, labels: DataFrame, max_rows: int = 10_000, id_col: str = "doc_id", text_col: str = "text", keep: bool = False) -> DataFrame:
    """One row for each row of docs: doc_id, held_out, score, predicted.

    Null and empty texts score what a margin of 0 does; a very long text is
    scored whole.  A null doc_id is not held out.  Repeated rows score alike.
    With no usable labels every text scores below 0.5; an empty table gives
    an empty one.  keep: all columns of docs come along, with these as
    __llm_score and __llm_predicted.
    """
    judge = docs.sparkSession.sparkContext.broadcast(train(docs, labels, max_rows, id_col, text_col))

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        j = judge.value
        return pd.Series(j.score(np.array([j.margin(t) for t in texts], float)))

    if keep:
        out = docs.withColumn("__llm_score", score(F.col(text_col)))
        return out.withColumn("__llm_predicted", (F.col("__llm_score") >= 0.5).cast("int"))
    out = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    out = out.select("doc_id", F.coalesce(fold(F.col("doc_id")) == 0, F.lit(False)).alias("held_out"), score("text").alias("score"))
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def without_toxic(docs: DataFrame, labels: DataFrame, max_rows: int = 10_000) -> DataFrame:
    """docs without those predicted toxic."""
    return toxicity(docs, labels, max_rows, keep=True).where("__llm_predicted = 0").drop("__llm_score", "__llm_predicted")
