"""The factorisation machine: its identity and gradient, and held-out labels."""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
import pytest
from cases import EDGE, frame

from fieldspark.llm import quality


def some_rows(n=5, seed=1):
    rng = np.random.default_rng(seed)
    machine = quality.Machine.new()
    machine.linear[:] = rng.normal(0, 0.1, machine.linear.shape)
    sizes = rng.integers(1, 6, n)
    index = np.concatenate([rng.choice(50, s, replace=False) for s in sizes]).astype(np.int32)
    return machine, index, rng.random(len(index)).astype(np.float32), np.cumsum(sizes) - sizes


def slow_margin(m, index, value):
    pairs = sum(float(m.vectors[i] @ m.vectors[j]) * a * b for k, (i, a) in enumerate(zip(index, value, strict=True)) for j, b in list(zip(index, value, strict=True))[k + 1 :])
    return float(m.constant[0]) + sum(float(m.linear[i]) * a for i, a in zip(index, value, strict=True)) + pairs


def test_linear_time_identity():
    machine, index, value, starts = some_rows(9)
    ends = np.append(starts, len(index))
    fast = machine.margins(index, value, starts)[0]
    assert np.allclose(fast, [slow_margin(machine, index[a:b], value[a:b]) for a, b in zip(ends[:-1], ends[1:], strict=True)], atol=1e-5)


def test_steps_lower_the_loss():
    machine, index, value, starts = some_rows(40)
    good = (np.arange(40) % 2).astype(np.float32)

    def loss():
        p = 1 / (1 + np.exp(-machine.margins(index, value, starts)[0]))
        return -np.mean(np.log(np.where(good == 1, p, 1 - p)))

    before = loss()
    for _ in range(200):
        machine.learn(index, value, starts, good)
    assert loss() < before / 2
    again = quality.Machine.unpacked(np.frombuffer(machine.packed(), np.float32))
    assert np.array_equal(again.vectors, machine.vectors) and np.array_equal(again.seen, machine.seen)


def test_interactions_learn_what_no_linear_score_can():
    """Good where exactly one of two features is there."""
    machine = quality.Machine.new()
    index, value = np.array([0, 2, 1, 2, 0, 1, 2, 2], np.int32), np.ones(8, np.float32)
    starts, good = np.array([0, 2, 4, 7]), np.array([1, 1, 0, 0], np.float32)
    for _ in range(3000):
        machine.learn(index, value, starts, good)
    assert (machine.margins(index, value, starts)[0] > 0).tolist() == [True, True, False, False]


def auc(score, y):
    order = np.argsort(np.argsort(score)) + 1.0
    n1 = y.sum()
    return (order[y == 1].sum() - n1 * (n1 + 1) / 2) / (n1 * (len(y) - n1))


def test_held_out_labels(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    rows = {r.doc_id: r for r in quality.quality(docs, labels).collect()}
    assert len(rows) == docs.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows.values())
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in rows.items())
    seen = [(rows[r.doc_id], r.quality) for r in labels.collect() if rows[r.doc_id].held_out]
    score, y = np.array([r.score for r, _ in seen]), np.array([q for _, q in seen])
    predicted = np.array([r.predicted for r, _ in seen])
    print("auc", auc(score, y), "good kept", predicted[y == 1].mean(), "poor kept", predicted[y == 0].mean(), len(y))
    assert auc(score, y) > 0.97 and predicted[y == 1].mean() > 0.98 and predicted[y == 0].mean() < 0.2


def test_labels_of_held_out_rows_and_other_columns_teach_nothing(spark):
    rows = [(i, ("good plain words here " if i % 3 else "### junk || $$ ") * 20 + str(i)) for i in range(200)]
    docs = frame(spark, rows)
    true = [(i, int(i % 3 > 0), 0) for i, _ in rows]
    lies = [(i, 1 - y if zlib.crc32(str(i).encode()) % 5 == 0 else y, 0) for i, y, _ in true]
    schema = "doc_id long, quality int, toxic int"
    a, b = (sorted(map(tuple, quality.quality(docs, spark.createDataFrame(x, schema)).collect())) for x in (true, lies))
    assert a == b
    assert all(p == int(i % 3 > 0) for i, _, _, p in a)


@pytest.mark.parametrize("labels", [[], [(5, 1, 0)], [(5, 0, 1), (3, 1, 0), (3, 0, 1), (None, 1, 1), (12, 2, 7), (13, None, None), (99, 0, 1)]])
def test_edges(spark, labels):
    told = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    out = quality.quality(frame(spark, EDGE), told, metadata=("n_chars", "lang")).collect()
    assert Counter(r.doc_id for r in out) == Counter(i for i, _ in EDGE) and all(0 <= r.score <= 1 for r in out)
    assert not any(r.held_out for r in out if r.doc_id is None)
    assert quality.quality(frame(spark, []), told, metadata=()).collect() == []


def test_statistics_of_odd_texts():
    for text in ("", "\n", "a", "\ud800 lone", "日本", "x" * 10_000):
        assert all(0 <= v <= 1 for k, v in quality.statistics(text, re.findall(r"[^\x20\x09-\x0D]+", text)).items() if k != "lines")
