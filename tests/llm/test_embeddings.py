"""Embedding deduplication against all pairs."""

from __future__ import annotations

import math
import tracemalloc

import numpy as np
import pandas as pd
import pytest
from cases import SF_DIR, components

from fieldspark.llm import cells, embedding_dedup


def table(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, node long, leaf long, vec binary, key string")


def rows_of(x):
    return [(i, None if v is None else [None if c is None else float(c) for c in v], 0, 1, 2, b"x", "k") for i, v in x]


def brute(x):
    good = {i: np.array(v, np.float32).astype(float) for i, v in x if v is not None and all(c is not None and math.isfinite(c) for c in v) and any(v)}
    links = []
    ids = sorted(good)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            p, q = good[a], good[b]
            if len(p) == len(q) and p @ q / math.sqrt((p @ p) * (q @ q)) >= 0.95:
                links.append((a, b))
    count = dict.fromkeys((i for i, _ in x), 0)
    for a, b in links:
        count[a] += 1
        count[b] += 1
    return links, count, components(list(count), links)


def planted(n=400, dim=24, seed=5):
    rng = np.random.default_rng(seed)
    centers = rng.standard_normal((12, dim))
    x = [(i, centers[i % 12] + 0.25 * rng.standard_normal(dim)) if i % 2 else (i, rng.standard_normal(dim)) for i in range(n)]
    x += [(n + i, x[1][1]) for i in range(40)]  # equal vectors
    odd = [None, [0.0] * dim, [math.nan] + [1.0] * (dim - 1), [math.inf] + [1.0] * (dim - 1), [None] + [1.0] * (dim - 1), [], [1.0, 2.0], [2.0, 4.0], [1e-30] * dim, [1e30] * dim]
    return x + [(n + 100 + i, v) for i, v in enumerate(odd)]


@pytest.mark.parametrize("cell_rows", [1024, 16])
def test_recall_and_no_false_links(spark, monkeypatch, cell_rows):
    monkeypatch.setattr(embedding_dedup, "CELL_ROWS", cell_rows)
    x = planted()
    links, count, want = brute(x)
    out = {r.vec_id: r for r in embedding_dedup.embedding_dedup(table(spark, rows_of(x)), leaf_rows=40).collect()}
    assert set(out) == set(count)
    assert all(out[i].n_links <= n for i, n in count.items())
    assert sum(r.n_links for r in out.values()) >= 0.9 * 2 * len(links)
    assert np.mean([out[i].component_id == want[i] for i in want]) >= 0.97
    assert all(r.kept == (r.vec_id == r.component_id) for r in out.values())


def test_whole_table_against_brute_force(spark):
    df = spark.read.parquet(f"{SF_DIR}/embeddings.parquet")
    x = [(r.vec_id, r.embedding) for r in df.collect()]
    links, count, want = brute(x)
    out = {r.vec_id: r for r in embedding_dedup.embedding_dedup(df).collect()}
    assert sum(r.n_links for r in out.values()) >= 0.9 * 2 * len(links)
    assert np.mean([out[i].component_id == want[i] for i in want]) >= 0.97


def test_empty_and_repeated_ids(spark):
    assert embedding_dedup.embedding_dedup(table(spark, [])).collect() == []
    out = embedding_dedup.embedding_dedup(table(spark, rows_of([(1, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [0.0, 1.0]), (None, [1.0, 0.0])]))).collect()
    assert sorted((r.vec_id or -1, r.n_links) for r in out) == [(-1, 0), (1, 0), (1, 1), (2, 1)]


def test_cells_meet_every_pair_once(spark):
    rows = spark.range(50).selectExpr("id", "CAST(id % 2 AS STRING) AS key")
    out = cells.pair_cells(rows, "key", "id", 6).collect()
    met = {}
    for r in out:
        met.setdefault((r.key, r.lo, r.hi), []).append((r.id, r.chunk))
    pairs = [(min(a, b), max(a, b)) for (_, lo, hi), own in met.items() for k, (a, ca) in enumerate(own) for b, cb in own[k + 1 :] if lo == hi or ca != cb]
    assert sorted(pairs) == [(a, b) for a in range(50) for b in range(a + 1, 50) if (a - b) % 2 == 0]


def test_a_cell_of_many_leaves_is_compared_in_bounded_memory():
    """Each of 900 linked rows lies in 150 leaves of its own: a matrix of rows by leaves would take 490 MB."""
    n, own = 900, 150
    rng = np.random.default_rng(3)
    x = (np.ones(16) + 0.01 * rng.standard_normal((n, 16))).astype("<f4")
    unit = 5 << embedding_dedup.TREE_BITS | 1
    lists = [np.append(np.arange(own) * 1000 + 1000 * own * i + 1, unit).astype(np.int64) for i in range(n)]
    lists[1] = lists[0]  # these two have met before
    cell = pd.DataFrame({"mult": np.ones(n, np.int64), "chunk": 0, "lo": 0, "hi": 0, "unit": unit, "vec": [v.tobytes() for v in x], "leaves": [v.tobytes() for v in lists]})
    tracemalloc.start()
    hit, counts, a, b = embedding_dedup.links_in(cell, 0.95, "<f4", 1024)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert dict(zip(hit.tolist(), counts.tolist(), strict=True)) == {i: n - 1 - (i < 2) for i in range(n)}
    assert len(a) == n - 1 and set(b.tolist()) == {0}
    assert peak < 150e6


def test_workers_stay_small_with_many_leaves(spark):
    """2500 vectors in some 200 leaves each, from one task: copies for every leaf would fill a batch of over 500 MB."""
    rng = np.random.default_rng(8)
    rows = [(i, rng.standard_normal(24).tolist()) for i in range(2500)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").coalesce(1)
    environment = spark.sparkContext.environment
    environment["FRESH_WORKERS"] = "embeddings"  # workers of their own, with a peak of their own
    try:
        assert embedding_dedup.embedding_dedup(df, trees=24, leaf_rows=16, spill=0.05).count() == 2500

        def peak(batches):
            for batch in batches:
                with open("/proc/self/status") as f:
                    batch["id"] = next(int(line.split()[1]) for line in f if line.startswith("VmHWM"))
                yield batch[:1]

        most = spark.range(64).repartition(32).mapInPandas(peak, "id long").agg({"id": "max"}).first()[0]
    finally:
        del environment["FRESH_WORKERS"]
    assert most < 500_000  # kB


@pytest.mark.parametrize(("group_rows", "pass_rows"), [(64, 1), (16, 10**9), (1, 10**9)])
def test_groups_and_passes_of_any_size_find_the_same(spark, monkeypatch, group_rows, pass_rows):
    """Groups that tasks split further, tight ones that are cut into cells, and trees taken one at a time."""
    monkeypatch.setattr(embedding_dedup, "GROUP_ROWS", group_rows)
    monkeypatch.setattr(embedding_dedup, "PASS_ROWS", pass_rows)
    x = planted()
    links, count, want = brute(x)
    out = {r.vec_id: r for r in embedding_dedup.embedding_dedup(table(spark, rows_of(x)), leaf_rows=40, sample_rows=200).collect()}
    assert set(out) == set(count)
    assert all(out[i].n_links <= n for i, n in count.items())
    assert sum(r.n_links for r in out.values()) >= 0.9 * 2 * len(links)
    assert np.mean([out[i].component_id == want[i] for i in want]) >= 0.97
