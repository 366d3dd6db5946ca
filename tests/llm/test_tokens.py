"""Token store, piece matching and packing against the libraries themselves."""

from __future__ import annotations

import hashlib
import tracemalloc
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from cases import EDGE, frame, texts
from hypothesis import given, settings
from hypothesis import strategies as st

from fieldspark.llm import packing, piece_matching, token_store, tokens
from fieldspark.llm.queries import tokenizer
from fieldspark.llm.storage import new_path

WORDS, BYTES, PIECES = tokenizer("word_bpe_49k.json"), tokenizer("byte_bpe_50k.json"), tokenizer("piece_bpe_32k.model")


def library_ids(path, text):
    from tokenizers import Tokenizer

    if path not in _open:
        _open[path] = Tokenizer.from_file(path)
    return _open[path].encode(text or "", add_special_tokens=False).ids


_open: dict = {}


def encoded(path, many):
    out = []
    for first, beyond, e in tokens.ChunkEncoder.of(path).encode(pa.array(many, pa.string())):
        found = [ids.tolist() for ids in e.each()]
        assert first == len(out) and len(found) == beyond - first
        out += found
    return out


ODD = ["", " ", "a  b", " lead", "trail ", "tabs\tand\nlines\r\n", "don't  stop", "<s> </s> <unk> [CLS]", "日本語 テキスト", "🙂 🙂🙂", "é é", " nbsp　wide", "x" * 5000, "3.14 1,000 100%", "ﬁ ligature"]


@pytest.mark.parametrize("path", [WORDS, BYTES])
def test_chunks_give_the_ids_of_whole_texts(spark, path):
    many = [*ODD, *(t for _, t in texts(spark)), *(t for _, t in EDGE), None]
    assert encoded(path, many) == [library_ids(path, text) for text in many]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet="ab .'\n\té<s>1🙂 \u00a0\u2003\u3000\u0301\x85Σ", max_size=40), max_size=4))
def test_chunks_of_random_texts(many):
    for path in (WORDS, BYTES):
        assert encoded(path, many) == [library_ids(path, text) for text in many]


def test_what_is_remembered_stays_bounded(monkeypatch):
    monkeypatch.setattr(tokens, "REMEMBERED", 50)
    monkeypatch.setattr(tokens, "KEPT", 20)
    monkeypatch.setattr(tokens, "SLICE", 30)
    encoder = tokens.ChunkEncoder(BYTES)
    many = [" ".join(f"w{i * j}" for j in range(9)) for i in range(60)]
    found = [ids.tolist() for _, _, e in encoder.encode(pa.array(many)) for ids in e.each()]
    assert found == [library_ids(BYTES, text) for text in many]
    assert 0 < len(encoder.known) <= 50


# -- the store


def test_store_gives_every_id_back(spark):
    rows = [(i, t) for i, t in [*texts(spark), *EDGE] if i is not None]
    path = new_path(spark, "test-store")
    root = token_store.write_store(frame(spark, rows), path, WORDS, 2)
    assert token_store.verify_manifest(spark, path) == root
    read = token_store.read_documents(spark, path).orderBy("start").collect()
    place = 0
    for r in read:
        assert r.start == place
        place += r.n_tokens
    assert [r.doc_id for r in read] == sorted(i for i, _ in rows)
    want = defaultdict(list)
    for i, t in rows:
        want[i].append([*library_ids(WORDS, t), 2])
    for r in read:
        assert list(r.ids) in want[r.doc_id]
    sums = {(r.doc_id, r.start): (r.n_tokens, r.ids_crc32) for r in token_store.document_checksums(spark, path).collect()}
    assert sums == {(r.doc_id, r.start): (len(r.ids), zlib.crc32(np.array(r.ids, "<u4").tobytes())) for r in read}
    chunks = spark.read.parquet(f"{path}/chunks")
    assert chunks.count() == chunks.select("digest").distinct().count()


def test_damage_is_found(spark):
    path, bad = new_path(spark, "store"), new_path(spark, "bad")
    token_store.write_store(frame(spark, [(1, "some text to keep"), (2, "and more")]), path, WORDS, 2)
    for part in ("recipes", "manifest"):
        spark.read.parquet(f"{path}/{part}").write.parquet(f"{bad}/{part}")
    spark.read.parquet(f"{path}/chunks").selectExpr("digest", "n", "unhex(concat(hex(payload), '0000')) AS payload").write.parquet(f"{bad}/chunks")
    with pytest.raises(Exception, match="is damaged"):
        token_store.read_documents(spark, bad).collect()
    worse = new_path(spark, "worse")
    spark.read.parquet(f"{path}/manifest").write.parquet(f"{worse}/manifest")
    spark.read.parquet(f"{path}/recipes").where("doc_id = 1").write.parquet(f"{worse}/recipes")
    with pytest.raises(ValueError, match="does not match"):
        token_store.verify_manifest(spark, worse)


@given(st.binary(max_size=200), st.binary(max_size=200))
def test_checksums_combine(a, b):
    assert token_store.crc32_combine(zlib.crc32(a), zlib.crc32(b), len(b)) == zlib.crc32(a + b)


@given(st.lists(st.lists(st.integers(0, 70_000), min_size=1, max_size=3000), min_size=1, max_size=4))
@settings(max_examples=30, deadline=None)
def test_cuts_cover_and_follow_content(docs):
    x, doc_ends = np.array(sum(docs, []), np.uint32), np.cumsum([len(d) for d in docs])
    ends, upto = token_store.cut(x, doc_ends)
    assert [ends[k - 1] for k in upto] == doc_ends.tolist() and upto[-1] == len(ends)
    sizes = np.diff([0, *ends])
    assert (sizes > 0).all() and (sizes <= token_store.MOST).all()
    # a document's chunks are its own: the same without its neighbours
    for k, d in enumerate(docs):
        alone, _ = token_store.cut(np.array(d, np.uint32), np.array([len(d)]))
        start = 0 if k == 0 else int(doc_ends[k - 1])
        assert [start + e for e in alone] == ends[0 if k == 0 else upto[k - 1] : upto[k]]


@given(st.lists(st.binary(max_size=3), max_size=40))
def test_tree_of_nodes_that_come_one_by_one(nodes):
    level = [hashlib.sha256(b"\0" + x).digest() for x in nodes] or [hashlib.sha256(b"").digest()]
    while len(level) > 1:
        level = [hashlib.sha256(b"\1" + level[i] + level[i + 1]).digest() if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
    assert token_store.merkle(nodes) == level[0]


# -- pieces


def test_pieces_are_those_of_the_library(spark):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    rows = [(k, t) for k, t in enumerate([*ODD, *(t for _, t in texts(spark)), *(t for _, t in EDGE)])]
    got = {r.doc_id: list(r.ids) for r in piece_matching.encode(frame(spark, rows), PIECES).collect()}
    assert got == {k: sp.encode(t or "") for k, t in rows}
    encoded = piece_matching.encode(frame(spark, rows), PIECES)
    assert {r.doc_id: r.text for r in piece_matching.decode(encoded, PIECES).collect()} == {k: sp.decode(v) for k, v in got.items()}


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=60))
def test_pieces_of_random_texts(text):
    m = piece_matching.Matcher.of(PIECES)
    assert m.encode([text])[0].tolist() == m.sp.encode(text)


# -- packing


def cost_of(at, pen, length, chosen):
    return sum(length - (at[b] - at[a]) + pen[b] for a, b in zip(chosen[:-1], chosen[1:], strict=True))


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 9), st.sampled_from([0.0, 1.0, 4.0])), min_size=1, max_size=60), st.integers(9, 40))
def test_cuts_are_the_best(steps, length):
    at = np.cumsum([0, *[s for s, _ in steps]])
    pen = np.array([0.0, *[p for _, p in steps]])
    chosen = packing.best_cuts(at, pen, length).tolist()
    best = [0.0]
    for j in range(1, len(at)):
        best.append(min(best[i] + length - (at[j] - at[i]) + pen[j] for i in range(j) if at[j] - at[i] <= length))
    assert chosen[0] == 0 and chosen[-1] == len(at) - 1
    assert all(at[b] - at[a] <= length for a, b in zip(chosen[:-1], chosen[1:], strict=True))
    assert abs(cost_of(at, pen, length, chosen) - best[-1]) < 1e-9


def test_a_large_batch_is_packed_in_bounded_memory():
    """17 MB of text in one batch: what lies beside the ids and what is remembered has to stay small."""
    rng = np.random.default_rng(6)
    words = np.array(["".join(rng.choice(list("abcdefghijklmnop"), int(rng.integers(3, 9)))) for _ in range(4000)])
    many = pa.array([" ".join(rng.choice(words, 20_000)) + "." for _ in range(130)])
    encoder, stream, pieces, n = tokens.ChunkEncoder.of(BYTES), packing.Stream(2048), [], 0
    tracemalloc.start()
    for first, beyond, e in encoder.encode(many):
        stream.add(list(range(first, beyond)), e.ids, e.ends, *packing.cut_points(e.chunk_ends[e.sentences()], e.ends, 2048))
        n += len(e.ids)
        if stream.n >= packing.STREAM:
            pieces += stream.pack(last=False)
    pieces += stream.pack(last=True)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert sum(p[2] for p in pieces) == n and encoded(BYTES, many[:2].to_pylist()) == [library_ids(BYTES, t) for t in many[:2].to_pylist()]
    assert peak < 90e6


def test_stream_loses_no_id_when_cut_early():
    rng = np.random.default_rng(4)
    stream, pieces, docs = packing.Stream(50), [], {}
    for i in range(200):
        ids = rng.integers(0, 1000, int(rng.integers(1, 180))).astype(np.uint32)
        docs[i] = ids
        ends = rng.random(len(ids)) < 0.1
        ends[-1] = True
        end = np.array([len(ids)])
        stream.add([i], ids, end, *packing.cut_points(np.flatnonzero(ends) + 1, end, 50))
        if stream.n > 700:
            pieces += stream.pack(last=False)
    pieces += stream.pack(last=True)
    check_pieces([(i, s, n, c, t, q, o) for i, s, n, c, t, q, o in pieces], docs, 50)


def check_pieces(pieces, docs, length):
    own, full = defaultdict(list), defaultdict(list)
    for doc, start, n, crc, total, seq, offset in pieces:
        ids = docs[doc]
        assert total == len(ids)
        assert crc == zlib.crc32(np.asarray(ids[start : start + n], "<u4").tobytes())
        own[doc].append((start, n))
        full[seq].append((offset, n))
    assert set(own) == set(docs)
    for parts, limit in [(p, len(docs[d])) for d, p in own.items()] + [(p, None) for p in full.values()]:
        place = 0
        for start, n in sorted(parts):
            assert start == place
            place += n
        assert place == limit if limit is not None else place <= length


def test_packing_of_a_table(spark):
    rows = [(i, t) for i, t in texts(spark)] + [(10**9, None), (10**9 + 1, "")]
    out = packing.pack(frame(spark, rows), BYTES, 1).collect()
    docs = {i: [*library_ids(BYTES, t), 1] for i, t in rows}
    pieces = [(r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens, r.sequence_id, r.offset) for r in out]
    check_pieces(pieces, docs, 2048)
    n = len({p[5] for p in pieces})
    assert {p[5] for p in pieces} == set(range(n))
    assert sum(map(len, docs.values())) >= 0.85 * 2048 * n
