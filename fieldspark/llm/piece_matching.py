"""SentencePiece encoding and decoding by matching pieces on a suffix array.

The distinct words of a batch (no piece of the vocabulary reaches over the
start of a word) are laid one after another and their suffixes sorted as far
as the longest piece reaches.  Every piece then finds its occurrences as one
range of the suffix array by binary search, all pieces at once.  Each
occurrence is an edge between two places in a word; the edges are sorted by
where they end, and relaxed in that order: a place takes, longest first, the
one edge whose piece may follow the piece that its start has taken.  Two
pieces may follow one another if merging the characters of both by the
vocabulary's ranks gives these two pieces again; with that test the path is
the one that merging the whole word would give.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import new_path, write_and_read

SPACE = "▁"
WORDS = re.compile(f"(?<=[^{SPACE}])(?={SPACE})")
#: Words and pairs of pieces that a worker remembers.
REMEMBERED = 600_000
#: Characters of text that are cut into words at once, and of new words whose suffixes are sorted at once.
PART, BATCH = 4_000_000, 400_000
NONE, FIRST, UNKNOWN = -1, -2, -3
#: Stands between words; a text may hold any character, NUL too.
BETWEEN = -1
_open: dict[str, Matcher] = {}


class Matcher:
    def __init__(self, path: str):
        import sentencepiece

        sp = self.sp = sentencepiece.SentencePieceProcessor(model_file=path)
        kinds = [(i, sp.id_to_piece(i)) for i in range(sp.get_piece_size())]
        plain = [(i, p) for i, p in kinds if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        self.byte = {int(p[3:5], 16): i for i, p in kinds if sp.is_byte(i)}
        self.piece = dict(kinds)
        of_byte = {i: bytes([b]) for b, i in self.byte.items()}
        self.raw = [of_byte[i] if i in of_byte else b"" if sp.is_control(i) else p.encode() for i, p in kinds]
        self.unknown = sp.unk_id()
        self.id = {p: i for i, p in plain}
        self.rank = {p: -sp.get_score(i) for i, p in plain}
        self.split_words = not any(SPACE in p.lstrip(SPACE) for _, p in plain)
        order = sorted(plain, key=lambda x: x[1])
        self.ids = np.array([i for i, _ in order], np.int64)
        self.longest = max(len(p) for _, p in plain)
        self.length = np.array([len(p) for _, p in order])
        self.codes = np.zeros((len(order), self.longest), np.int32)
        for k, (_, p) in enumerate(order):
            self.codes[k, : len(p)] = [ord(c) for c in p]
        self.size = sp.get_piece_size() + 4
        self.words: dict[str, bytes] = {}
        self.pair_keys, self.pair_fits = np.zeros(0, np.int64), np.zeros(0, bool)

    @classmethod
    def of(cls, path: str) -> Matcher:
        if path not in _open:
            _open[path] = cls(path)
        return _open[path]

    # -- pairs of pieces

    def merged(self, text: str) -> list[str]:
        """Characters merged by rank, leftmost first: only for the few characters of two pieces."""
        parts = list(text)
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                r = self.rank.get(parts[i] + parts[i + 1])
                if r is not None and (best is None or r < best):
                    best, at = r, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def fits(self, before: np.ndarray, piece: np.ndarray) -> np.ndarray:
        """Whether piece may follow before; UNKNOWN and FIRST go with everything that stands alone."""
        key = (before + 3) * self.size + piece + 3
        at = np.searchsorted(self.pair_keys, key)
        known = np.zeros(len(key), bool)
        inside = at < len(self.pair_keys)
        known[inside] = self.pair_keys[at[inside]] == key[inside]
        if known.all():
            return self.pair_fits[at]
        new = np.unique(key[~known])
        if len(new):
            if len(self.pair_keys) > 2 * REMEMBERED:
                self.pair_keys, self.pair_fits = np.zeros(0, np.int64), np.zeros(0, bool)
                new = np.unique(key)
            told = np.array([self._fits(int(k // self.size) - 3, int(k % self.size) - 3) for k in new])
            place = np.searchsorted(self.pair_keys, new)
            self.pair_keys, self.pair_fits = np.insert(self.pair_keys, place, new), np.insert(self.pair_fits, place, told)
        return self.pair_fits[np.searchsorted(self.pair_keys, key)]

    def _fits(self, a: int, b: int) -> bool:
        if b == UNKNOWN:
            return True
        p = self.piece[b]
        if a < 0:
            return self.merged(p) == [p]
        q = self.piece[a]
        return self.merged(q + p) == [q, p]

    # -- suffix array

    def suffixes(self, codes: np.ndarray) -> np.ndarray:
        """Starts in the order of the first longest characters from there: prefix doubling."""
        _, rank = np.unique(codes, return_inverse=True)
        order, reach = np.argsort(rank), 1
        n = len(codes)
        while reach < self.longest:
            second = np.zeros(n, np.int64)
            second[: max(0, n - reach)] = rank[reach:] + 1
            key = rank * np.int64(n + 1) + second
            order = np.argsort(key)
            sorted_key = key[order]
            rank = np.empty(n, np.int64)
            rank[order] = np.cumsum(np.r_[False, sorted_key[1:] != sorted_key[:-1]])
            reach *= 2
        return order

    def ranges(self, codes: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each piece, the range of the suffix array whose suffixes start with it."""
        n = len(order)
        low, high = np.zeros(len(self.ids), np.int64), np.full(len(self.ids), n)
        padded = np.concatenate([codes, np.full(self.longest + 1, BETWEEN, codes.dtype)])
        for k in range(self.longest):
            live = np.flatnonzero((self.length > k) & (low < high))
            want = self.codes[live, k]
            ends = []
            for right in (False, True):
                a, b = low[live].copy(), high[live].copy()
                while (open_ := a < b).any():
                    mid = (a + b) // 2
                    c = padded[order[np.minimum(mid, n - 1)] + k]
                    below = (c <= want) if right else (c < want)
                    a = np.where(open_ & below, mid + 1, a)
                    b = np.where(open_ & ~below, mid, b)
                ends.append(a)
            low[live], high[live] = ends
        return low, high

    # -- encoding

    def learn(self, words: set[str]) -> None:
        new = [w for w in words if w not in self.words]
        if len(self.words) + len(new) > REMEMBERED and self.words:
            self.words, new = {}, list(words)
        at, batch = 0, []
        for w in new:
            batch.append(w)
            at += len(w) + 1
            if at > BATCH:
                self._learn(batch)
                at, batch = 0, []
        if batch:
            self._learn(batch)

    def _learn(self, words: list[str]) -> None:
        text = "\0".join(words) + "\0"
        codes = np.frombuffer(text.encode("utf-32-le"), "<u4").astype(np.int32)
        sizes = np.array([len(w) for w in words])
        start = np.cumsum(np.r_[0, sizes[:-1] + 1])
        codes[start + sizes] = BETWEEN
        order = self.suffixes(codes)
        low, high = self.ranges(codes, order)
        many = high - low
        pick = np.repeat(low, many) + np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many)
        edge_from, edge_len, edge_id = order[pick], np.repeat(self.length, many), np.repeat(self.ids, many)
        # a character without a piece of its own is an edge by itself
        have = np.zeros(len(codes), bool)
        have[edge_from[edge_len == 1]] = True
        lone = np.flatnonzero(~have & (codes != BETWEEN))
        edge_from = np.concatenate([edge_from, lone])
        edge_len = np.concatenate([edge_len, np.ones(len(lone), np.int64)])
        edge_id = np.concatenate([edge_id, np.full(len(lone), UNKNOWN)])
        word_start = np.repeat(start, sizes + 1)
        end = edge_from + edge_len
        depth = end - word_start[edge_from]
        by_end = np.argsort((depth * np.int64(len(codes) + 1) + end) * np.int64(self.longest + 1) + (self.longest - edge_len))
        edge_from, edge_len, edge_id, end, depth = edge_from[by_end], edge_len[by_end], edge_id[by_end], end[by_end], depth[by_end]
        taken, step = np.full(len(codes) + 1, NONE, np.int64), np.zeros(len(codes) + 1, np.int64)
        cuts = np.flatnonzero(np.r_[True, depth[1:] != depth[:-1]]) if len(depth) else np.zeros(0, int)
        for a, b in zip(cuts, np.r_[cuts[1:], len(depth)], strict=True):
            src, ids, to, size = edge_from[a:b], edge_id[a:b], end[a:b], edge_len[a:b]
            before = np.where(src == word_start[src], FIRST, taken[src])
            live = np.flatnonzero(before != NONE)
            while len(live):
                lead = live[np.r_[True, to[live][1:] != to[live][:-1]]]  # the longest open edge of each place
                good = lead[self.fits(before[lead], ids[lead])]
                taken[to[good]], step[to[good]] = ids[good], size[good]
                rest = np.ones(len(b0 := live), bool)
                rest[np.r_[True, to[b0][1:] != to[b0][:-1]]] = False
                live = b0[rest]
                live = live[taken[to[live]] == NONE]
        if len(taken) and (taken[start + sizes] == NONE).any():
            raise RuntimeError("a word without a path")
        # back from the ends, one piece of every word at a time
        at, live, trail = start + sizes, np.arange(len(words)), []
        while len(live):
            trail.append((live, taken[at[live]]))
            at[live] -= step[at[live]]
            live = live[at[live] > start[live]]
        word = np.concatenate([w for w, _ in trail])
        turn = np.repeat(np.arange(len(trail)), [len(w) for w, _ in trail])
        ids = np.concatenate([i for _, i in trail])
        order = np.argsort(word * np.int64(len(trail)) + (len(trail) - 1 - turn))
        word, ids = word[order], ids[order]
        many = np.bincount(word, minlength=len(words))
        strange = set(word[ids == UNKNOWN].tolist())
        raw = ids.astype("<u4").tobytes()
        last = 0
        for k, (w, n) in enumerate(zip(words, many.tolist(), strict=True)):
            self.words[w] = self._spelt(w, ids[last : last + n]) if k in strange else raw[4 * last : 4 * (last + n)]
            last += n

    def _spelt(self, word: str, ids: np.ndarray) -> bytes:
        """The ids of a word with characters that no piece has: as bytes, if the vocabulary has them."""
        out, at = [], 0
        for i in ids.tolist():
            if i == UNKNOWN:
                out.extend([self.byte[b] for b in word[at].encode()] if self.byte else [self.unknown])
            else:
                out.append(i)
            at += 1 if i == UNKNOWN else len(self.piece[i])
        return np.array(out, "<u4").tobytes()

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        out, cut, need, size = [], [], set(), 0
        for k, text in enumerate(texts, 1):
            s = self.sp.normalize(text)
            cut.append([w for w in WORDS.split(s) if w] if self.split_words else [s] * bool(s))
            need.update(cut[-1])
            size += len(s)
            # documents in parts, so that what they need is remembered together
            if k == len(texts) or size > PART or len(need) > REMEMBERED // 3:
                self.learn(need)
                out.extend(np.frombuffer(b"".join(map(self.words.__getitem__, ws)), "<u4") for ws in cut)
                cut, need, size = [], set(), 0
        return out

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids: byte pieces as UTF-8, control pieces as nothing, the space before the first word dropped."""
        raw = b"".join(map(self.raw.__getitem__, ids.tolist()))
        text = raw.decode("utf-8", errors="replace").replace(SPACE, " ")
        return text[1:] if text.startswith(" ") else text


def encode(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and ids (array<int>) of every whole text; null is empty, and an empty text has no ids."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = Matcher.of(model)
        for b in batches:
            yield pd.DataFrame({"doc_id": b["doc_id"], "ids": [x.astype(np.int32) for x in m.encode(b["text"].tolist())]})

    return _rows(docs, id_col, text_col).mapInPandas(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, model: str) -> DataFrame:
    """doc_id and text of rows (doc_id, ids)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = Matcher.of(model)
        for b in batches:
            yield pd.DataFrame({"doc_id": b["doc_id"], "text": [m.decode(np.asarray(x)) for x in b["ids"]]})

    return encoded.select("doc_id", "ids").mapInPandas(run, "doc_id long, text string")


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def round_trip(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: doc_id, n_tokens, ids_crc32, restored (decoding gives the text again).

    A null text is empty and has no tokens; a very long one is encoded whole,
    word by word.  Of equal scores the same edge wins everywhere, and repeated
    rows are encoded alike.  An empty table gives an empty one.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = Matcher.of(model)
        for b in batches:
            ids = m.encode(b["text"].tolist())
            crc = [zlib.crc32(x.tobytes()) for x in ids]
            same = [m.decode(x) == t for x, t in zip(ids, b["text"], strict=True)]
            yield pd.DataFrame({"doc_id": b["doc_id"], "n_tokens": [len(x) for x in ids], "ids_crc32": crc, "restored": same})

    out = _rows(docs, id_col, text_col).mapInPandas(run, "doc_id long, n_tokens long, ids_crc32 long, restored boolean")
    return write_and_read(out, new_path(docs.sparkSession, "pieces"))
