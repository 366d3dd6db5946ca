"""Small tables that hold what production tables may hold, and plain helpers to compare with."""

from __future__ import annotations

from itertools import combinations

SF_DIR = "/root/testdata/sf0.001"
#: documents' columns, and some whose names the operators use themselves.
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, digest string, part int, kept boolean, bytes long, shard string, block int, h long, y int, fold int, leaf long, node long"
LONG = " ".join(f"word{i % 997} of a very long text." for i in range(12_000))


def frame(spark, rows):
    """documents of (doc_id, text) with all further columns null."""
    return spark.createDataFrame([(i, t, *[None] * 14) for i, t in rows], SCHEMA)


def texts(spark, sf_dir=SF_DIR):
    """(doc_id, text) of all documents."""
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]


EDGE = [
    (5, "Hello World, this is a text that stands here more than once, in capitals or not, for all to see."),
    (3, "hello world, this is a text that stands here more than once, in capitals or not, for all to see."),
    (3, "hello world, this is a text that stands here more than once, in capitals or not, for all to see."),
    (3, "another text under the same id"),
    (None, "a text without an id"), (None, None), (None, "a text without an id"),
    (7, None), (8, ""), (9, " \t\n "), (10, LONG), (11, LONG + " and an end"), (12, "one"), (-4, "one"),
    (13, "naïve Ünïcode ßtraße İstanbul 日本語のテキスト 🙂🙂 é"), (14, "\x00 odd \x01 bytes \x7f"), (15, "ab" * 300), (16, "ba" * 300), (2**62, "an id beyond 53 bits"),
]


def components(nodes, links):
    """The smallest node that each reaches."""
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def all_links(items, near):
    return [(a, b) for (a, x), (b, y) in combinations(items, 2) if near(x, y)]
