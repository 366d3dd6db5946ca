"""Each operator on nulls, empty and long texts, ties, repeated rows, clashing names and empty tables."""

from __future__ import annotations

from collections import Counter

import pytest
from cases import EDGE, frame

from fieldspark.llm import exact_dedup, packing, piece_matching, secret_scan, sharding, simhash, suffix_dedup, token_store, toxicity
from fieldspark.llm.queries import tokenizer


def labels(spark, rows=((5, 0, 1), (3, 1, 0), (3, 0, 1), (None, 1, 1), (12, 2, 7), (13, None, None), (99, 0, 1))):
    return spark.createDataFrame(list(rows), "doc_id long, quality int, toxic int")


ROW_FOR_ROW = {
    "piece_matching": lambda s, d: piece_matching.round_trip(d, tokenizer("piece_bpe_32k.model")),
    "suffix_dedup": lambda s, d: suffix_dedup.suffix_dedup(d),
    "token_store": lambda s, d: token_store.store_checksums(d, tokenizer("word_bpe_49k.json"), 2),
    "simhash": lambda s, d: simhash.simhash_dedup(d),
    "toxicity": lambda s, d: toxicity.toxicity(d, labels(s)),
    "sharding": lambda s, d: sharding.shards(d, 5000),
    "exact_dedup": lambda s, d: exact_dedup.exact_dedup(d),
}


@pytest.mark.parametrize("name", ROW_FOR_ROW)
def test_one_row_for_each_row(spark, name):
    out = ROW_FOR_ROW[name](spark, frame(spark, EDGE)).collect()
    assert Counter(r.doc_id for r in out) == Counter(i for i, _ in EDGE)


@pytest.mark.parametrize("name", ROW_FOR_ROW)
def test_empty_table(spark, name):
    assert ROW_FOR_ROW[name](spark, frame(spark, [])).collect() == []


def test_packing_edges(spark):
    out = packing.pack(frame(spark, EDGE), tokenizer("byte_bpe_50k.json"), 1).collect()
    assert {r.doc_id for r in out} == {i for i, _ in EDGE}
    assert all(r.length > 0 for r in out)
    assert packing.pack(frame(spark, []), tokenizer("byte_bpe_50k.json"), 1).collect() == []


def test_secret_edges(spark):
    assert secret_scan.scan(frame(spark, [])).collect() == []
    docs = frame(spark, EDGE)
    same = secret_scan.redacted(docs)
    assert same.columns == docs.columns
    assert Counter(map(tuple, same.select("doc_id", "text").collect())) == Counter(EDGE)


def test_filters_keep_columns(spark):
    docs = frame(spark, EDGE)
    for out in (exact_dedup.keep_first(docs), simhash.keep_near(docs), toxicity.without_toxic(docs, labels(spark))):
        assert out.columns == docs.columns
        assert out.count() > 0
    kept = exact_dedup.keep_first(docs).select("doc_id", "text").collect()
    assert len(kept) == len({(t or "").lower() if (t or "").isascii() else t for _, t in EDGE})
    empty = frame(spark, [])
    for out in (exact_dedup.keep_first(empty), simhash.keep_near(empty), toxicity.without_toxic(empty, labels(spark, ()))):
        assert out.collect() == []


def test_toxicity_without_labels(spark):
    out = toxicity.toxicity(frame(spark, EDGE), labels(spark, ())).collect()
    assert {r.predicted for r in out} == {0}
    assert all(0 <= r.score < 0.5 for r in out)
