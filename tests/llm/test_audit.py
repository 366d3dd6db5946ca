"""The filter audit against a plain version and its SQL, and its scanner against regular expressions."""

from __future__ import annotations

import re
from collections import Counter
from itertools import permutations

import numpy as np
import oracle
import pyarrow as pa
import pytest
from cases import EDGE, SF_DIR
from hypothesis import given, settings
from hypothesis import strategies as st

from fieldspark.llm import filter_audit, queries

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def plain_fails(text):
    words = WORDS.findall(text)
    return "".join(
        f for f, bad in zip("ABCD", (len(words) < 50, 100 * len(set(words)) < 65 * len(words), 100 * len(re.findall("[A-Z]", text)) > 5 * len(text), re.search(r"[#$%&*|]", text)), strict=True) if bad
    )


def masks(texts):
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts, pa.string())], ["doc_id", "text"])
    return next(filter_audit.scanned(iter([batch]))).column("mask").to_pylist()


def as_mask(fails):
    return sum(1 << "ABCDE".index(f) for f in fails)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(st.sampled_from("aAbB é\t\x0b\x1f\x85\u2003日🙂$|"), max_size=80), min_size=1, max_size=12))
def test_scanner_against_regular_expressions(texts):
    assert masks(texts) == [as_mask(plain_fails(t)) for t in texts]


@pytest.mark.parametrize("step", [1, 7, 64])
def test_scanner_by_slices(monkeypatch, step):
    """Slices and words of any length give what one slice gives."""
    texts = [t or "" for _, t in EDGE] + ["x" * 300 + " " + "x" * 300 + " " + "x" * 299, "word " * 80, "w1 w2 " * 40, "A b C d " * 20, ""]
    monkeypatch.setattr(filter_audit, "SLICE_BYTES", step)
    short = [t for t in texts if len(t) < 5000]
    assert masks(short) == [as_mask(plain_fails(t)) for t in short]


@pytest.mark.parametrize("hashes", [lambda d, s, e: np.zeros(len(s), np.uint64), lambda d, s, e: (e - s).astype(np.uint64)])
def test_words_of_one_hash_are_told_apart(hashes):
    data = np.frombuffer(b"a bb a cc bb dd a b", np.uint8)
    start, end = np.array([0, 2, 5, 7, 10, 13, 16, 18]), np.array([1, 4, 6, 9, 12, 15, 17, 19])
    text = np.array([0, 0, 0, 0, 0, 1, 1, 1])
    assert filter_audit.distinct_words(data, start, end, text, 3, hashes).tolist() == [3, 3, 0]


def brute(rows, labels):
    least = {}
    for i, t, _ in rows:
        if i is not None:
            least[t or ""] = min(i, least.get(t or "", i))
    fails = [(p or "", plain_fails(t or "") + "E" * (i is not None and least[t or ""] < i), labels.get(i, (0, 0))) for i, t, p in rows]
    out = Counter()
    names = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
    for part in {p for p, _, _ in fails}:
        removed_by = Counter()
        for order in map("".join, permutations("ABCDE")):
            for k, f in enumerate(order):
                for p, bad, (good, toxic) in fails:
                    if p != part:
                        continue
                    gone, hit = any(x in bad for x in order[:k]), f in bad
                    out[part, order, k + 1, "kept"] += not gone and not hit
                    out[part, order, k + 1, "removed"] += hit and not gone
                    out[part, order, k + 1, "redundant"] += hit and gone
                    out[part, order, k + 1, "unique_fails"] += bad == f
                    out[part, order, k + 1, "good_lost"] += hit and not gone and good
                    out[part, order, k + 1, "toxic_lost"] += hit and not gone and toxic
                    removed_by[f] += hit and not gone
        for order in map("".join, permutations("ABCDE")):
            for k, f in enumerate(order):
                out[part, order, k + 1, "shapley"] = removed_by[f]
    return {(p, o, s): tuple(int(out[p, o, s, n]) for n in names) for p, o, s, _ in out}


def told(df):
    return {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley) for r in df.collect()}


def test_audit_against_brute_force(spark):
    rows = [(i, t, ("a", "b", None, "")[k % 4]) for k, (i, t) in enumerate(EDGE)] + [(i, "the same | text " * 9, "a") for i in (30, 31, 31, 32)]
    docs = spark.createDataFrame([(i, t, p) for i, t, p in rows], "doc_id long, text string, source string").crossJoin(spark.sql("SELECT 1 AS mask, 'x' AS part, 2 AS step, 'y' AS digest, 3 AS n"))
    labels = spark.createDataFrame([(5, 1, 0, 9), (5, 0, 1, 9), (3, 1, None, 9), (30, None, 1, 9), (31, 1, 1, 9), (None, 1, 1, 9), (99, 1, 1, 9)], "doc_id long, quality int, toxic int, first int")
    plain = {5: (1, 1), 3: (1, 0), 30: (0, 1), 31: (1, 1)}
    out = filter_audit.filter_audit(docs, labels)
    assert told(out) == brute(rows, plain)


def test_audit_of_an_empty_table(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, source string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_audit.filter_audit(empty, labels).collect() == []
    one = spark.createDataFrame([(None, None, None)], "doc_id long, text string, source string")
    out = filter_audit.filter_audit(one, labels).collect()
    assert len(out) == 600 and {r.part for r in out} == {""} and {r.redundant for r in out} == {0}


def test_audit_agrees_with_sql(spark):
    assert oracle.compare(queries.op13_filter_audit(spark, SF_DIR), oracle.connected(SF_DIR), queries.ORACLE_SQL["op13_filter_audit"]) == ""
