"""What moves: texts once to their shard, and only weights that training has changed to the driver."""

from __future__ import annotations

import numpy as np
import pandas as pd

from fieldspark.llm import quality, sharding


def test_texts_do_not_move_to_find_their_shard(spark):
    """The directory goes to the rows, also where Spark would not send it by itself."""
    docs = spark.createDataFrame([(i, "text") for i in [*range(50), None]], "doc_id long, text string")
    listed = sharding.directory(sharding.shards(docs, 60))
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = sharding.in_shards(docs, listed, "shard")
        assert "SortMergeJoin" not in found._jdf.queryExecution().executedPlan().toString()
        got = {r.doc_id: r.shard for r in found.collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    assert got == {r.doc_id: "b" + r.shard for r in sharding.shards(docs, 60).collect()} and len(got) == 51


def test_a_part_sends_back_what_it_has_changed():
    """The weights of a part that has seen few words are small, and put together they are the average of whole machines."""
    machine = quality.Machine.new()

    class Shared:
        value = machine.packed()

    def part(word: str, y: int, many: int) -> pd.DataFrame:
        index, value = quality.features(word, {})
        return pd.DataFrame({"y": [y] * many, "digest": range(many), "index": [index.astype("<i4").tobytes()] * many, "value": [value.astype("<f4").tobytes()] * many})

    told = [quality._once(Shared, 0)(f).iloc[0] for f in (part("one two", 1, 3), part("two three", 0, 5))]
    assert all(len(t["at"]) + len(t["weights"]) < len(Shared.value) / 100 for t in told)
    new = quality.averaged(machine, told)
    whole = [quality.averaged(machine, [t]) for t in told]
    for name in ("constant", "linear", "vectors", "seen"):
        a, b = (getattr(w, name) for w in whole)
        assert np.allclose(getattr(new, name), a * (3 / 8) + b * (5 / 8), atol=1e-6)
    assert new.margins(*_entries("three"))[0] < machine.margins(*_entries("three"))[0]


def _entries(text: str):
    index, value = quality.features(text, {})
    return index, value, np.zeros(1, np.int64)
