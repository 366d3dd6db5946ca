"""The pipeline as a whole on odd tables: repeated ids, nulls, clashing columns, no rows."""

from __future__ import annotations

import pytest
from cases import EDGE, frame

import corpus_pipeline


def tables(spark, path, rows):
    frame(spark, rows).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(5, 0, 1), (3, 1, 0), (None, 1, 1), (12, 2, 7)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return f"file://{path}"


@pytest.mark.parametrize("rows", [EDGE, [], [(None, None)] * 3], ids=["edges", "empty", "nulls"])
def test_every_stage(spark, tmp_path, rows):
    sf_dir = tables(spark, tmp_path, rows)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, sf_dir)
        if name != "packing":
            assert out.columns == docs.columns
        out.write.parquet(f"file://{tmp_path}/stage-{k}")
        before, docs = docs, spark.read.parquet(f"file://{tmp_path}/stage-{k}")
        if name != "packing":
            assert docs.count() <= before.count()
    assert (docs.count() == 0) == (not rows)
    if rows is EDGE:
        ids = {r.doc_id for r in docs.collect()}
        assert {10, 13, 14, 2**62} <= ids  # clean documents stay
        kept = {(r.doc_id, r.text) for r in before.collect()}
        assert (3, "another text under the same id") in kept
    assert corpus_pipeline.run(spark, sf_dir).count() == docs.count()
