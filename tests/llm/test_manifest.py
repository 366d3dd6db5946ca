"""The Merkle manifest against a plain recursion, by any number of partitions."""

from __future__ import annotations

import hashlib
import zlib
from collections import Counter

import oracle
import pytest
from cases import EDGE, SF_DIR

from fieldspark.llm import manifest, queries


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(row):
    return H(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def plain_tree(nodes):
    """Root, and the siblings of each leaf, level by level."""
    paths, where, level = [[] for _ in nodes], list(range(len(nodes))), list(nodes)
    while len(level) > 1:
        for k, j in enumerate(where):
            run = j // 3 * 3
            paths[k].append((level[run:j], level[j + 1 : run + 3]))
            where[k] = j // 3
        level = [H(*level[r : r + 3]) for r in range(0, len(level), 3)]
    return level[0], paths


def brute(rows):
    """rows: doc_id, source, lang, n_chars, text."""
    groups = {}
    for r in rows:
        groups.setdefault(r[1], []).append(r)
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    roots, own = [], []
    for g in order:
        found = sorted(groups[g], key=lambda r: (r[0] is not None, r[0] or 0, leaf_of(r)))
        root, paths = plain_tree([leaf_of(r) for r in found])
        roots.append(root)
        own.append((root, list(zip(found, paths, strict=True))))
    top, over = plain_tree(roots)
    out = []
    for (root, found), further in zip(own, over, strict=True):
        for r, path in found:
            steps = path + further
            changed = r
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0 and r[4] is not None:
                changed = (*r[:4], r[4].replace("\n", ""))
            node = leaf_of(changed)
            for left, right in steps:
                node = H(*left, node, *right)
            out.append((r[0], leaf_of(r), root, top, H(*("".join(a + b) for a, b in steps)), node, node == top))
    return Counter(out)


def told(df):
    return Counter((r.doc_id, r.leaf, r.subroot, r.root, r.proof_sha256, r.folded_root, r.verified) for r in df.collect())


def docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string").selectExpr("*", "1 AS leaf", "2 AS id", "3 AS node", "4 AS level", "5 AS place", "6 AS root", "'x' AS `group`", "7 AS `order`")


MANY = [(i * 7 % 1000, ("hot", "hot", "b", "é", None, "")[i % 6] if i < 900 else f"s{i % 40}", None, i, f"text\n{i}") for i in range(1000)]


@pytest.mark.parametrize("shuffles", [1, 3, 8, 40])
def test_manifest_by_partitions(spark, shuffles):
    """Ragged ends at any place; a group over many partitions, and many groups in one."""
    held = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", shuffles)
    try:
        rows = MANY if shuffles != 3 else [r for r in MANY if r[1] != "hot"] + [(i, "hot", "en", None, "a\nb") for i in range(2100)]
        assert told(manifest.tampered_manifest(docs(spark, rows))) == brute(rows)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", held)


def test_blocks_of_leaves(spark, monkeypatch):
    """What memory holds at once, and the levels of a round, change nothing."""
    nodes = [H(str(i)) for i in range(500)]
    _, paths = plain_tree(nodes)
    for block in (1, 2, 6):
        monkeypatch.setattr(manifest, "BLOCK", block)
        made = list(manifest._local("g", 0, 500, bytearray(b"".join(map(bytes.fromhex, nodes))), list(range(500))))
        assert [r[0] for r in made] == list(range(500))
        assert [[(a.hex(), b.hex()) for a, b in r[6]] for r in made] == [[("".join(a), "".join(b)) for a, b in p] for p in paths]
    part = list(manifest._local("g", 100, 500, bytearray(b"".join(map(bytes.fromhex, nodes[100:300]))), list(range(200))))
    tops = [r for r in part if r[0] is None]
    assert len(tops) < 24 and sum(min(3 ** (r[2]), 500 - r[3] * 3 ** r[2]) for r in tops) == 200


def test_manifest_edges(spark):
    rows = [(i, ("a", None, "")[k % 3], "en", k, t) for k, (i, t) in enumerate(EDGE)] + [(3, "a", None, None, "same"), (3, "a", None, None, "same")]
    assert told(manifest.tampered_manifest(docs(spark, rows))) == brute(rows)
    assert told(manifest.tampered_manifest(docs(spark, rows[:1]))) == brute(rows[:1])
    assert manifest.tampered_manifest(docs(spark, [])).collect() == []


def test_proofs_are_returned(spark):
    out = manifest.manifest(docs(spark, MANY[:40]), manifest.COLUMNS, keep={"doc_id": manifest.F.col("doc_id")}).collect()
    for r in out:
        node = r.leaf
        for left, right in r.proof:
            node = H(left.hex(), node, right.hex())
        assert node == r.root


def test_manifest_agrees_with_sql(spark):
    assert oracle.compare(queries.op12_merkle_manifest(spark, SF_DIR), oracle.connected(SF_DIR), queries.ORACLE_SQL["op12_merkle_manifest"]) == ""
