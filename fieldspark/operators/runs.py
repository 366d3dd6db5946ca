"""Run-length decoding of rays, for whole Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

END, LITERAL = 1, 0x8000


def decode(words: np.ndarray, missing: int) -> np.ndarray:
    """16-bit words: 1 ends; with the high bit, as many words follow as they are; without it, so many are missing."""
    out, at = [], 0
    while at < len(words) and words[at] != END:
        n, literal = int(words[at]) & (LITERAL - 1), int(words[at]) & LITERAL
        at += 1
        if literal:
            out.append(words[at : at + n])
            at += n
        else:
            out.append(np.full(n, missing & 0xFFFF, np.uint16))
    return np.concatenate(out).astype(np.int16) if out else np.zeros(0, np.int16)


def decode_rows(words: np.ndarray, first: np.ndarray, last: np.ndarray, wide: int, missing: int) -> np.ndarray:
    """What decode makes of the words first to last of each row, all rows at a time, cut or filled up to wide values."""
    out = np.full([len(first), wide], missing & 0xFFFF, np.uint16)
    row, at, end, place = np.arange(len(first)), first.astype(np.int64), last.astype(np.int64), np.zeros(len(first), np.int64)
    while len(row):
        live = np.flatnonzero((at < end) & (place < wide))
        live = live[words[at[live]] != END]
        row, at, end, place = row[live], at[live], end[live], place[live]
        told = words[at].astype(np.int64)
        n, literal = told & (LITERAL - 1), told >= LITERAL
        copied(words, at + 1, np.where(literal, np.minimum(np.minimum(n, end - at - 1), wide - place), 0), out, row, place)
        place, at = place + n, at + 1 + np.where(literal, n, 0)
    return out.view(np.int16)


def copied(words: np.ndarray, at: np.ndarray, many: np.ndarray, out: np.ndarray, row: np.ndarray, place: np.ndarray | int = 0) -> None:
    """Puts many words from at on into each row of out, from place on."""
    turn = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
    out[np.repeat(row, many), np.repeat(np.broadcast_to(place, many.shape), many) + turn] = words[np.repeat(at, many) + turn]


def decoded(rays: DataFrame, key: str, words: str, missing: int) -> DataFrame:
    """key and values (array<int>) of rays whose column of words (array<int>) is run-length coded."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            coded = batch.column(words)
            flat, ends = coded.flatten().to_numpy(zero_copy_only=False).astype(np.uint16), np.cumsum(coded.value_lengths().fill_null(0).to_numpy())
            made = [decode(flat[a:b], missing) for a, b in zip([0, *ends[:-1]], ends, strict=True)]
            values = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, made)]), pa.int32()), pa.array(np.concatenate([np.zeros(0, np.int16), *made]), pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(key), values], names=[key, "values"])

    return rays.select(key, words).mapInArrow(run, f"{key} long, values array<int>")


def encode(values: np.ndarray, missing: int) -> np.ndarray:
    """16-bit values as such words: runs of missing ones, of at least two since 1 ends, and literal runs."""
    gone = values == missing
    cuts = np.flatnonzero(np.diff(gone.astype(np.int8))) + 1
    words, plain = [], []

    def literal() -> None:
        if plain:
            held = np.concatenate(plain)
            words.append(np.concatenate([[len(held) | LITERAL], held.view(np.uint16)]).astype(np.uint16))
            plain.clear()

    for a, b in zip([0, *cuts], [*cuts, len(values)], strict=True):
        if b - a > 1 and gone[a]:
            literal()
            words.append(np.array([b - a], np.uint16))
        elif b > a:
            plain.append(values[a:b].astype(np.int16))
    literal()
    return np.concatenate([*words, np.array([END], np.uint16)])


def encode_rows(values: np.ndarray, missing: int) -> tuple[np.ndarray, np.ndarray]:
    """What encode makes of each row of values, one row's words behind the other's, and how many words a row has."""
    gone = values == missing
    gap = np.zeros_like(gone)
    gap[:, 1:] = gone[:, :-1]
    gap[:, :-1] |= gone[:, 1:]
    gap &= gone  # a lone missing value stands among the others
    start = np.ones_like(gone)
    start[:, 1:] = gap[:, 1:] != gap[:, :-1]
    size = np.concatenate([start.astype(np.int64) + ~gap, np.ones([len(values), 1], np.int64)], 1, dtype=np.int64)
    at = (np.cumsum(size) - size.ravel()).reshape(size.shape)[:, :-1]
    out = np.full(int(size.sum()), END, np.uint16)
    heads = np.flatnonzero(start)
    out[at.ravel()[heads]] = np.diff(np.append(heads, start.size)) | np.where(gap.ravel()[heads], 0, LITERAL)
    out[(at + start)[~gap]] = values[~gap].astype(np.int16).view(np.uint16)
    return out, size.sum(1)
