"""Exact, SimHash and suffix deduplication against brute force."""

from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from cases import EDGE, all_links, components, frame, texts
from hypothesis import given, settings
from hypothesis import strategies as st

from fieldspark.llm import exact_dedup, simhash, suffix_dedup


def plain_lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


# -- exact


def brute_exact(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[plain_lower(t)].append(i)
    out = []
    for i, t in rows:
        own = groups[plain_lower(t)]
        keep = max((x for x in own if x is not None), default=None)
        out.append((i, keep, len(own), i == keep, hashlib.sha256(plain_lower(t).encode()).hexdigest()))
    return sorted(out, key=repr)


def test_exact_against_brute_force(spark):
    for rows in (EDGE, texts(spark)):
        out = exact_dedup.exact_dedup(frame(spark, rows)).collect()
        assert sorted(map(tuple, out), key=repr) == brute_exact(rows)


def test_index_persists_and_grows(spark):
    index = exact_dedup.DigestIndex(spark, "digest_index_of_a_test", 4)
    try:
        first = exact_dedup.exact_dedup(frame(spark, [(1, "a"), (2, "A"), (3, "b")]), index)
        assert {r.doc_id for r in first.collect() if r.kept} == {2, 3}
        again = exact_dedup.DigestIndex(spark, "digest_index_of_a_test", 4)
        second = exact_dedup.exact_dedup(frame(spark, [(4, "B"), (5, "c"), (6, "c"), (7, None)]), again).collect()
        assert {(r.doc_id, r.keep_id, r.kept) for r in second} == {(4, 3, False), (5, 6, False), (6, 6, True), (7, 7, True)}
        assert index.table().count() == 4
        plan = again.new_of(first.select(exact_dedup.F.col("text_sha256").alias("digest")))._jdf.queryExecution().toString()
        assert "SortMergeJoin" in plan
        again.compact()
        assert again.table().count() == 4
    finally:
        index.drop()


def test_a_batch_given_again_has_the_same_answer(spark):
    """As after a run that has died behind its append."""
    index = exact_dedup.DigestIndex(spark, "digest_index_of_reruns", 4)
    try:
        exact_dedup.exact_dedup(frame(spark, [(1, "a"), (2, "b")]), index, batch="one")
        rows = frame(spark, [(3, "A"), (4, "c"), (5, "C"), (6, None)])
        runs = [sorted(map(tuple, exact_dedup.exact_dedup(rows, index, batch="two").collect())) for _ in range(2)]
        assert runs[0] == runs[1] and [r[0] for r in runs[0] if r[3]] == [5, 6]
        assert index.table().count() == 4
        assert [r.doc_id for r in exact_dedup.keep_first(rows, index, batch="two").orderBy("doc_id").collect()] == [5, 6]
    finally:
        index.drop()


def test_index_reopens_from_its_location(spark):
    """A session that knows the location alone finds the index, before and after compaction, and after one that died."""
    index = exact_dedup.DigestIndex(spark, "digest_index_here", 4)
    try:
        exact_dedup.exact_dedup(frame(spark, [(1, "a"), (2, "b")]), index)
        exact_dedup.exact_dedup(frame(spark, [(3, "c")]), index)
        for round_ in range(2):
            spark.sql(f"DROP TABLE {index.name}")  # as a session without the metastore of the first
            index = exact_dedup.DigestIndex(spark, f"digest_index_there_{round_}", location=index.location)
            assert index.buckets == 4 and index.table().count() == 3
            seen = exact_dedup.exact_dedup(frame(spark, [(9, "A"), (10, "C")]), index).collect()
            assert {(r.keep_id, r.kept) for r in seen} == {(1, False), (3, False)}
            index.compact()
            assert index.table().count() == 3
        dead = exact_dedup.DigestIndex(spark, "digest_index_dead", location=index.location)
        dead.spark.createDataFrame([("x", 1, "b")], "digest string, keep_id long, batch string").write.parquet(index._folder(index.version + 1) + "/_temporary/0")
        again = exact_dedup.DigestIndex(spark, "digest_index_again", location=index.location)
        assert again.version == index.version and again.table().count() == 3
        again.compact()
        assert again.table().count() == 3 and len(again._versions()) == 1
        with pytest.raises(ValueError):
            exact_dedup.DigestIndex(spark, location=index.location, buckets=8)
        for other in (dead, again):
            spark.sql(f"DROP TABLE {other.name}")
    finally:
        index.drop()


def test_exact_batches_against_one(spark):
    rows = [*EDGE, *((i, f"Text {i % 7}") for i in range(20, 60))]
    one, many = (sorted(map(repr, exact_dedup.exact_dedup(frame(spark, rows), batches=k).collect())) for k in (1, 4))
    assert one == many


def test_later_batches_lose_what_earlier_ones_brought(spark):
    index = exact_dedup.DigestIndex(spark, "digest_index_batches", 4)
    try:
        seen, new_of = [], index.new_of
        index.new_of = lambda groups: seen.append((groups.count(), new_of(groups).count())) or new_of(groups)
        exact_dedup.exact_dedup(frame(spark, [(i, f"t{i % 10}") for i in range(40)]), index, batches=2)
        assert seen == [(10, 10), (10, 0)] and index.table().count() == 10
    finally:
        index.drop()


# -- simhash


def slow_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", plain_lower(text))
    grams = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [" ".join(words)] * bool(words)
    h = [xxhash.xxh64(g.encode(), seed=42).intdigest() for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def near(a, b):
    return (a ^ b).bit_count() <= 2


@pytest.mark.parametrize("cell_rows", [2048, 3])
def test_simhash_against_brute_force(spark, monkeypatch, cell_rows):
    monkeypatch.setattr(simhash, "CELL_ROWS", cell_rows)
    base = "the quick brown fox jumps over the lazy dog and runs away from all of them into the deep dark wood at night"
    extra = [(10**6 + k, base.replace("night", f"night{k % 23}")) for k in range(120)] + [(10**7 + k, None) for k in range(4)]
    rows = [*texts(spark), *extra]
    fp = {i: slow_fingerprint(t) for i, t in rows}
    want = components(fp, all_links(list(fp.items()), near))
    out = simhash.simhash_dedup(frame(spark, rows)).collect()
    assert {r.doc_id: r.fingerprint for r in out} == {i: f"{f:016x}" for i, f in fp.items()}
    assert {r.doc_id: r.component_id for r in out} == want


@settings(max_examples=30, deadline=None)
@given(st.integers(0, 2**32), st.integers(1, 200), st.integers(1, 2))
def test_bit_planes_find_all_links(seed, n, radius):
    rng = np.random.default_rng(seed)
    centers = rng.integers(0, 2**63, 5, np.uint64)
    fp = np.unique(np.array([int(c) ^ (1 << int(rng.integers(64))) ^ (1 << int(rng.integers(64))) for c in rng.choice(centers, n)], np.uint64))
    ids, chunk = np.arange(len(fp)), np.zeros(len(fp), np.int64)
    a, b = simhash.links_within([(ids, fp[:, None], chunk)], radius)
    want = all_links(list(enumerate(fp.tolist())), lambda x, y: (x ^ y).bit_count() <= radius)
    assert components(ids.tolist(), zip(a.tolist(), b.tolist(), strict=True)) == components(ids.tolist(), want)


def test_near_copies_go_and_others_stay(spark):
    rng = np.random.default_rng(3)
    rows = []
    for k in range(30):
        words = [f"w{x}" for x in rng.integers(0, 5000, 200)]
        rows.append((k, " ".join(words)))
        if k % 3 == 0:  # Jaccard of five-word shingles: about 0.95
            words[100] = "changed"
            rows.append((1000 + k, " ".join(words)))
    kept = {r.doc_id for r in simhash.keep_near(frame(spark, rows)).collect()}
    assert kept == set(range(30))


def five_words(text):
    return set(zip(*(text.split()[i:] for i in range(5)), strict=False))


def jaccard(x, y):
    return len(x & y) / len(x | y)


@pytest.mark.parametrize("cell_rows", [1024, 3])
def test_near_groups_against_brute_force_jaccard(spark, monkeypatch, cell_rows):
    """Pairs from 0.75 to 0.9, and a group whose members are near to its first only."""
    monkeypatch.setattr(simhash, "SET_CELL_ROWS", cell_rows)
    rng = np.random.default_rng(8)
    rows, pairs = [], []
    for k in range(160):
        words = [f"w{x}" for x in rng.integers(0, 100_000, 240)]
        copy, tail = list(words), 12 + k % 24
        copy[len(copy) - tail :] = [f"v{x}" for x in rng.integers(0, 100_000, tail)]
        rows += [(k, " ".join(words)), (1000 + k, " ".join(copy))]
        pairs.append(jaccard(five_words(rows[-2][1]), five_words(rows[-1][1])))
    words = [f"u{x}" for x in range(240)]
    rows.append((2000, " ".join(words)))
    for k in range(12):
        rows.append((2001 + k, " ".join([*words[: 18 * k], *(f"t{k}_{x}" for x in range(18)), *words[18 * k + 18 :]])))
    assert min(pairs) < 0.76 and max(pairs) > 0.89
    links = all_links([(i, five_words(t)) for i, t in rows], lambda x, y: jaccard(x, y) >= 0.8)
    got = {r.doc_id: r.component_id for r in simhash.near_groups(frame(spark, rows)).collect()}
    assert got == components([i for i, _ in rows], links)


def test_bands_find_pairs_in_a_table_of_any_size():
    """The share of pairs that is compared, by calculation and for made sets, does not know the table's size."""
    for similarity in (0.5, 0.8, 0.9):
        assert (1 - similarity**simhash.ROWS) ** simhash.bands_for(similarity) < 1e-4
    rng = np.random.default_rng(4)
    factors = rng.integers(0, 1 << 63, (simhash.BANDS, simhash.ROWS)).astype(np.uint64) * np.uint64(2) + np.uint64(1)
    missed = 0
    for _ in range(1000):
        h = rng.integers(0, 1 << 63, 100).astype(np.uint64) * np.uint64(2)
        missed += not (simhash.band_keys(h[:90], factors) == simhash.band_keys(h[10:], factors)).any()
    assert missed <= 2


# -- suffixes


def brute_suffix(rows, length=50):
    first = {}
    for i, t in rows:
        b = (t or "").encode()
        for k in range(len(b) - length + 1):
            g = b[k : k + length]
            first[g] = min(first.get(g, i), i)
    out = {}
    for i, t in rows:
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for k in range(len(b) - length + 1):
            if first[b[k : k + length]] < i:
                gone[k : k + length] = True
        spans = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
        out[i] = (len(b), int(gone.sum()), spans, hashlib.sha256(np.frombuffer(b, np.uint8)[~gone].tobytes()).hexdigest())
    return out


def planted(seed=1):
    rng = np.random.default_rng(seed)
    word = lambda: "".join(chr(97 + c) for c in rng.integers(0, 26, int(rng.integers(2, 9))))
    passage = [" ".join(word() for _ in range(int(rng.integers(6, 30)))) for _ in range(6)]
    rows = []
    for i in rng.permutation(80).tolist():
        parts = [" ".join(word() for _ in range(int(rng.integers(0, 20)))) for _ in range(3)]
        parts.insert(1, passage[int(rng.integers(6))][int(rng.integers(0, 20)) :])
        rows.append((i, "é".join(parts)))
    return [*rows, (100, rows[0][1]), (101, "ab" * 100), (102, "x" + "ab" * 60), (103, ""), (104, None), (105, "a" * 49), (106, "a" * 50), (107, "a" * 51)]


@pytest.mark.parametrize(("block", "names"), [(8 << 20, 2_000_000), (700, 500)])
def test_suffix_against_brute_force(spark, monkeypatch, block, names):
    monkeypatch.setattr(suffix_dedup, "BLOCK_BYTES", block)
    monkeypatch.setattr(suffix_dedup, "BUCKET_NAMES", names)
    rows = planted()
    out = suffix_dedup.suffix_dedup(frame(spark, rows)).collect()
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in out} == brute_suffix(rows)


def test_suffix_other_length(spark):
    rows = planted(2)
    out = suffix_dedup.suffix_dedup(frame(spark, rows), length=30).collect()
    assert {r.doc_id: r.n_removed for r in out} == {i: v[1] for i, v in brute_suffix(rows, 30).items()}


def test_covers_are_perfect():
    for v, cover in suffix_dedup.COVERS.items():
        assert {(a - b) % v for a in cover for b in cover} == set(range(v))


def test_keep_near_tells_rows_of_one_id_apart(spark):
    """A row never goes because another row of its id has a copy."""
    words = [f"word{i}" for i in range(60)]
    a, b, c = " ".join(words), " ".join(f"other{i}" for i in range(40)), " ".join(f"third{i}" for i in range(50))
    rows = [(3, a), (5, a + " more"), (5, b), (9, c), (9, None), (9, ""), (11, c + " x"), (None, a), (12, b), (13, a), (13, a)]
    assert Counter(simhash.keep_near(frame(spark, rows)).select("doc_id", "text").collect()) == Counter([(3, a), (5, b), (9, c), (9, None), (9, ""), (None, a)])
    twice = [(3, a), (3, a + " more"), (4, a), (3, b), (3, b)]
    kept = simhash.keep_near(frame(spark, twice)).select("doc_id", "text").collect()
    assert sorted(r.doc_id for r in kept) == [3, 3] and {r.text == b for r in kept} == {True, False}
