"""The registered query of each operator: production parameters, whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import embedding_dedup, exact_dedup, filter_audit, manifest, packing, piece_matching, quality, secret_scan, sharding, simhash, suffix_dedup, token_store, toxicity

#: Where the public tokenizers' files are; None asks their package.
TOKENIZERS: str | None = None
SHARD_BYTES = 4_000_000
#: Batches in which the exact-dedup query feeds its index.
BATCHES = 3


def tokenizer(name: str) -> str:
    if TOKENIZERS:
        return f"{TOKENIZERS}/{name}"
    import public_tokenizers

    return public_tokenizers.path(name)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_matching.round_trip(_table(spark, sf_dir, "documents"), tokenizer("piece_bpe_32k.model"))


def op2_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.embedding_dedup(_table(spark, sf_dir, "embeddings"))


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.suffix_dedup(_table(spark, sf_dir, "documents"))


def op4_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_store.store_checksums(_table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"), 2)


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan(_table(spark, sf_dir, "documents"))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_dedup(_table(spark, sf_dir, "documents"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.written_shards(_table(spark, sf_dir, "documents"), SHARD_BYTES)


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"), 1)


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(_table(spark, sf_dir, "documents"), batches=BATCHES)


def op11_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest.tampered_manifest(_table(spark, sf_dir, "documents"))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.filter_audit(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_sentencepiece, op2_embedding_dedup, op3_suffix_dedup, op4_token_store, op5_secret_scan, op6_simhash, op7_toxicity,
        op8_sharding, op9_packing, op10_exact_dedup, op11_quality, op12_merkle_manifest, op13_filter_audit,
    )
}

_BYTES = "list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))"
_CRC = f"xor(list_reduce(list_prepend(4294967295, {_BYTES}), lambda c, b: list_reduce(list_prepend(xor(c, b), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda x, y: CASE WHEN x % 2 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)), 4294967295)"


def _leaf_sql(text: str) -> str:
    values = ["CAST(doc_id AS VARCHAR)", "source", "lang", "CAST(n_chars AS VARCHAR)", text]
    return "sha256(" + " || ".join(f"coalesce(octet_length(encode({v})) || ':' || {v}, '-')" for v in values) + ")"


def _tree_sql(name: str, leaves: str) -> str:
    """CTEs name_up (tree, level, j, node, n) and name_runs (tree, level, run, nodes) over leaves (tree, j, node)."""
    return f"""{name}_up AS (
            SELECT tree, 0 AS level, j, node, count(*) OVER (PARTITION BY tree) AS n FROM {leaves}
            UNION ALL SELECT tree, level + 1, j // 3, sha256(string_agg(node, '' ORDER BY j)), (n + 2) // 3 FROM {name}_up WHERE n > 1 GROUP BY tree, level, j // 3, n
        ), {name}_runs AS (
            SELECT tree, level, j // 3 AS run, list(node ORDER BY j) AS nodes FROM {name}_up WHERE n > 1 GROUP BY tree, level, j // 3
        )"""


def _walk_sql(name: str, start: str) -> str:
    """CTE name_walk: from start (item, tree, j, node, proof) up to the root."""
    return f"""{name}_walk AS (
            SELECT item, tree, 0 AS level, j, node, proof FROM {start}
            UNION ALL SELECT item, w.tree, w.level + 1, j // 3,
                sha256(array_to_string(nodes[1:j % 3], '') || node || array_to_string(nodes[j % 3 + 2:], '')), proof || array_to_string(nodes[1:j % 3], '') || array_to_string(nodes[j % 3 + 2:], '')
            FROM {name}_walk w JOIN {name}_runs r ON r.tree IS NOT DISTINCT FROM w.tree AND r.level = w.level AND r.run = w.j // 3
        ), {name}_end AS (SELECT * FROM {name}_walk QUALIFY level = max(level) OVER (PARTITION BY item))"""


_HEX_DIGIT = "(strpos('0123456789abcdef', substr(md5(CAST(doc_id AS VARCHAR)), {0}, 1)) - 1)"
_HASH = " + ".join(f"CAST({_HEX_DIGIT.format(i + 1)} AS BIGINT) * {16 ** (14 - i)}" for i in range(15))

ORACLE_SQL: dict[str, str] = {
    "op2_embedding_dedup": """
        WITH RECURSIVE v AS (
            SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
        ), links AS (
            SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id
            WHERE list_cosine_similarity(a.e, b.e) >= 0.95
        ), reach AS (
            SELECT vec_id, vec_id AS r FROM v
            UNION SELECT reach.vec_id, links.b FROM reach JOIN links ON reach.r = links.a
        )
        SELECT v.vec_id, CAST((SELECT count(*) FROM links WHERE a = v.vec_id) AS BIGINT) AS n_links,
               c.component_id, v.vec_id = c.component_id AS kept
        FROM v JOIN (SELECT vec_id, min(r) AS component_id FROM reach GROUP BY vec_id) c USING (vec_id)""",
    "op3_suffix_dedup": """
        WITH d AS (
            SELECT doc_id, lower(hex(encode(coalesce(text, '')))) AS h FROM documents
        ), b AS (
            SELECT doc_id, h, CAST(length(h) // 2 AS BIGINT) AS n FROM d
        ), grams AS (
            SELECT doc_id, i, substr(h, 2 * i + 1, 100) AS g
            FROM (SELECT doc_id, h, unnest(range(0, n - 49)) AS i FROM b WHERE n >= 50)
        ), gone AS (
            SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY md5(g)) AS first FROM grams) WHERE first < doc_id
        ), spans AS (
            SELECT doc_id, min(i) AS s, max(i) + 50 AS e
            FROM (SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS run
                  FROM (SELECT doc_id, i, CASE WHEN i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) <= 50 THEN 0 ELSE 1 END AS new FROM gone))
            GROUP BY doc_id, run
        ), kept AS (
            SELECT doc_id, e AS s, lead(s) OVER (PARTITION BY doc_id ORDER BY s) AS e FROM spans
            UNION ALL SELECT doc_id, 0, min(s) FROM spans GROUP BY doc_id
        ), parts AS (
            SELECT kept.doc_id, string_agg(substr(h, 2 * s + 1, 2 * (coalesce(e, n) - s)), '' ORDER BY s) AS h
            FROM kept JOIN b USING (doc_id) GROUP BY kept.doc_id
        ), sums AS (
            SELECT doc_id, CAST(sum(e - s) AS BIGINT) AS n_removed, CAST(count(*) AS BIGINT) AS n_spans FROM spans GROUP BY doc_id
        )
        SELECT b.doc_id, b.n AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
               sha256(unhex(coalesce(parts.h, b.h))) AS kept_sha256
        FROM b LEFT JOIN sums USING (doc_id) LEFT JOIN parts USING (doc_id)""",
    "op8_sharding": f"""
        WITH d AS (
            SELECT doc_id, CAST(coalesce(octet_length(encode(text)), 0) AS BIGINT) AS n_bytes, {_HASH} AS h FROM documents
        ), sums AS (
            SELECT depth, h >> (60 - depth) AS bits, CAST(sum(n_bytes) AS BIGINT) AS bytes, count(*) AS n
            FROM d, (SELECT unnest(range(0, 25)) AS depth) GROUP BY ALL
        ), shard AS (
            SELECT s.* FROM sums s LEFT JOIN sums p ON p.depth = s.depth - 1 AND p.bits = s.bits >> 1
            WHERE s.bytes <= {SHARD_BYTES} AND (s.depth = 0 OR p.bytes > {SHARD_BYTES})
        )
        SELECT doc_id, n_bytes, CAST(depth AS BIGINT) AS local_depth,
               CASE WHEN depth = 0 THEN '' ELSE right(lpad(bin(bits), 64, '0'), depth) END AS shard,
               bytes AS shard_bytes, n AS shard_rows
        FROM d JOIN shard ON shard.bits = d.h >> (60 - depth)""",
    "op10_exact_dedup": f"""
        WITH d AS (
            SELECT doc_id, sha256(translate(coalesce(text, ''), '{exact_dedup.UPPER}', '{exact_dedup.LOWER}')) AS text_sha256 FROM documents
        )
        SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
               doc_id = max(doc_id) OVER w AS kept, text_sha256
        FROM d WINDOW w AS (PARTITION BY text_sha256)""",
    "op12_merkle_manifest": f"""
        WITH RECURSIVE d AS (
            SELECT row_number() OVER () AS item, doc_id, source, {_leaf_sql("text")} AS leaf,
                   CASE WHEN {_CRC} % 2 = 0 THEN {_leaf_sql("replace(text, chr(10), '')")} END AS changed
            FROM documents
        ), leaves AS (
            SELECT source AS tree, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS j, leaf AS node, * FROM d
        ), {_tree_sql("own", "leaves")}, subroots AS (
            SELECT tree AS source, node AS subroot FROM own_up WHERE n = 1
        ), tops AS (
            SELECT 0 AS tree, row_number() OVER (ORDER BY encode(source) NULLS FIRST) - 1 AS j, subroot AS node, source, subroot FROM subroots
        ), {_tree_sql("all", "tops")}, own_start AS (
            SELECT item, tree, j, coalesce(changed, leaf) AS node, '' AS proof FROM leaves
        ), {_walk_sql("own", "own_start")}, all_start AS (
            SELECT item, 0 AS tree, tops.j, own_end.node, own_end.proof FROM own_end JOIN tops ON tops.source IS NOT DISTINCT FROM own_end.tree
        ), {_walk_sql("all", "all_start")}
        SELECT doc_id, leaf, subroot, up.node AS root, sha256(e.proof) AS proof_sha256, e.node AS folded_root, e.node = up.node AS verified
        FROM d JOIN all_end e USING (item) JOIN subroots s ON s.source IS NOT DISTINCT FROM d.source JOIN all_up up ON up.n = 1""",
    "op13_filter_audit": """
        WITH d AS (
            SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t FROM documents
        ), w AS (
            SELECT *, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') AS ws FROM d
        ), f AS (
            SELECT doc_id, part,
                   CASE WHEN len(ws) < 50 THEN 'A' ELSE '' END
                   || CASE WHEN 100 * len(list_distinct(ws)) < 65 * len(ws) THEN 'B' ELSE '' END
                   || CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 5 * length(t) THEN 'C' ELSE '' END
                   || CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END
                   || CASE WHEN min(doc_id) OVER (PARTITION BY t) < doc_id THEN 'E' ELSE '' END AS fails
            FROM w
        ), l AS (
            SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id
        ), c AS (
            SELECT part, fails, count(*) AS n, sum(coalesce(good, 0)) AS good, sum(coalesce(toxic, 0)) AS toxic FROM f LEFT JOIN l USING (doc_id) GROUP BY part, fails
        ), x AS (
            SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x
        ), o AS (
            SELECT p.x || q.x || r.x || s.x || t.x AS filter_order FROM x p, x q, x r, x s, x t
            WHERE len(list_distinct([p.x, q.x, r.x, s.x, t.x])) = 5
        ), e AS (
            SELECT *, substr(filter_order, step, 1) AS letter, strpos(fails, substr(filter_order, step, 1)) > 0 AS hit,
                   length(translate(substr(filter_order, 1, step - 1), fails, '')) < step - 1 AS gone
            FROM c, o, (SELECT CAST(unnest(range(1, 6)) AS INTEGER) AS step)
        ), s AS (
            SELECT part, filter_order, step, letter,
                   sum(CASE WHEN NOT hit AND NOT gone THEN n ELSE 0 END) AS kept, sum(CASE WHEN hit AND NOT gone THEN n ELSE 0 END) AS removed,
                   sum(CASE WHEN hit AND gone THEN n ELSE 0 END) AS redundant, sum(CASE WHEN fails = letter THEN n ELSE 0 END) AS unique_fails,
                   sum(CASE WHEN hit AND NOT gone THEN good ELSE 0 END) AS good_lost, sum(CASE WHEN hit AND NOT gone THEN toxic ELSE 0 END) AS toxic_lost
            FROM e GROUP BY part, filter_order, step, letter
        )
        SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
               CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
               CAST(sum(removed) OVER (PARTITION BY part, letter) AS BIGINT) AS shapley
        FROM s""",
}
