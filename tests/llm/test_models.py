"""Secret scanning, toxicity, sharding and the pipeline."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import regex
from cases import EDGE, SF_DIR, all_links, components, frame, texts
from pyspark.sql import functions as F

import corpus_pipeline
from fieldspark.llm import exact_dedup, packing, secret_scan, sharding, simhash, toxicity
from fieldspark.llm.queries import tokenizer

# -- secrets


@pytest.fixture(scope="module")
def forest(spark):
    return secret_scan.train(secret_scan.labelled_findings(spark))


def test_forest_on_findings_it_has_not_seen(spark, forest):
    new = secret_scan.labelled_findings(spark, 9000).where("candidate IS NOT NULL").exceptAll(secret_scan.labelled_findings(spark, 6000))
    made = secret_scan.features(F.col("candidate"), F.col("before"), F.col("after"), F.col("path"))
    out = new.withColumn("f", F.array(*made)).select("label", secret_scan.as_column(forest, F.col("f")).alias("p")).collect()
    assert np.mean([(r.p >= 0.5) == (r.label == 1) for r in out]) >= 0.95


def test_column_is_the_forest(spark, forest):
    from pyspark.ml.feature import VectorAssembler

    made = secret_scan.features(F.col("candidate"), F.col("before"), F.col("after"), F.col("path"))
    rows = secret_scan.labelled_findings(spark, 300).select(*[c.alias(n) for c, n in zip(made, secret_scan.FEATURES, strict=True)])
    rows = VectorAssembler(inputCols=secret_scan.FEATURES, outputCol="features").transform(rows).withColumn("f", F.array(*secret_scan.FEATURES))
    out = forest.transform(rows).select("probability", secret_scan.as_column(forest, F.col("f")).alias("p")).collect()
    assert all(abs(r.probability[1] - r.p) < 1e-9 for r in out)


KEY = "ghp_Zx81kQpL0vTn5RwY3sBmC7dHfJ2gUe9aXo4i"
SHA = hashlib.sha256(b"x").hexdigest()[:40]


def test_secrets_found_and_others_left(spark, forest):
    rows = [(1, f'first api_key = "{KEY}" and more'), (2, f"see commit {SHA} of the day"), (3, "no digits in here_at_all_really"), (4, f'a token: "{KEY}" b secret = "{KEY[::-1]}" c'), (5, None)]
    out = secret_scan.scan(frame(spark, rows), forest).collect()
    assert {(r.doc_id, r.start) for r in out if r.is_secret} == {(i, m.start()) for i, t in rows if i in (1, 4) for m in re.finditer(f"{KEY}|{KEY[::-1]}", t)}
    assert {r.candidate_sha256 for r in out if not r.is_secret} == {hashlib.sha256(SHA.encode()).hexdigest()}
    masked = {r.doc_id: r.text for r in secret_scan.redacted(frame(spark, rows), forest).collect()}
    assert masked == {1: 'first api_key = "[SECRET]" and more', 2: rows[1][1], 3: rows[2][1], 4: 'a token: "[SECRET]" b secret = "[SECRET]" c', 5: None}


def test_long_secrets_and_key_blocks_are_masked_whole(spark, forest):
    rng = np.random.default_rng(6)
    signs = np.array(list("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"))
    values = ["".join(rng.choice(signs, n)) for n in (32, 64, 6000)]
    values += ["".join(rng.choice(list("0123456789abcdef"), n)) for n in (32, 40, 64, 128)]
    values.append("".join(rng.choice(signs[:52], 400)) + "7Qx")  # the first digit comes late
    lines = "".join("".join(rng.choice(signs, 64)) + "\n" for _ in range(196))
    for kind, head in (("RSA ", "Proc-Type: 4,ENCRYPTED\nDEK-Info: AES-128-CBC,0A1B2C3D\n\n"), ("", ""), ("EC ", "")):
        values.append(f"-----BEGIN {kind}PRIVATE KEY-----\n{head}{lines}-----END {kind}PRIVATE KEY-----")
    rows = [(i, f'first api_key = "{v}" and more') for i, v in enumerate(values)]
    found = secret_scan.scan(frame(spark, rows), forest).collect()
    assert sorted((r.doc_id, r.start, r.n_chars) for r in found) == [(i, 17, len(v)) for i, v in enumerate(values)]
    masked = {r.doc_id: r.text for r in secret_scan.redacted(frame(spark, rows), forest).collect()}
    assert masked == {i: 'first api_key = "[SECRET]" and more' for i in range(len(values))}
    clean = [(i, f"see commit {''.join(rng.choice(list('0123456789abcdef'), n))} of the day") for i, n in enumerate((32, 40, 64, 128))]
    assert not any(r.is_secret for r in secret_scan.scan(frame(spark, clean), forest).collect())


def test_values_that_key_words_assign(spark, forest):
    """Short values and such without a digit are secrets, words and references in their place are not."""
    secret = ["Amber-Canyon-Harvest-Piano", "hT7#kQ2w", "zQvXbTnMwKpLrJdF", "r4V!x9Lm2", "Silent-River-Marble-Kite"]
    other = ["required", "self.config.value", "get_token(request)", "${MY_TOKEN}", "forgotten"]
    rows = [(i, f'and then password = "{v}" was set') for i, v in enumerate(secret + other)] + [(99, "the password: is short, a tokens: 12 of")]
    found = {(r.doc_id, r.start): r for r in secret_scan.scan(frame(spark, rows), forest).collect()}
    assert all((i, 21) in found for i in range(len(secret)))
    told = {i for (i, _), r in found.items() if r.is_secret}
    assert told == set(range(len(secret)))
    masked = {r.doc_id: r.text for r in secret_scan.redacted(frame(spark, rows), forest).collect()}
    assert all(masked[i] == ('and then password = "[SECRET]" was set' if i < len(secret) else t) for i, t in rows)


def test_scan_of_a_table_against_a_rule_of_its_own(spark, forest):
    """In the test tables, what a key word assigns is a secret and any other candidate is not."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    known = docs.select("doc_id", "text")
    rows = secret_scan.scan(docs, forest).join(known, "doc_id").select("is_secret", F.expr("substring(text, cast(greatest(start - 13, 1) as int), cast(least(start, 14) as int))").alias("left")).collect()
    told = Counter((bool(re.search('(?i)token = "$', r.left)), r.is_secret) for r in rows)
    assert told[True, True] > 100 < told[False, False]
    assert told[True, True] >= 0.98 * (told[True, True] + told[True, False])
    assert told[True, True] >= 0.98 * (told[True, True] + told[False, True])


def test_length_does_not_tell_the_kind(spark):
    """Every length of hexadecimal stands among the secrets and among the others."""
    rows = secret_scan.labelled_findings(spark, 3000).where("candidate RLIKE '^[0-9a-f]+$'").select("label", F.length("candidate").alias("n")).distinct().collect()
    assert {r.n for r in rows if r.label == 1} >= {32, 40, 64, 128} <= {r.n for r in rows if r.label == 0}


def test_scan_runs_no_python(spark, forest):
    plan = secret_scan.scan(frame(spark, [(1, "x")]), forest)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_candidates_of_a_table(spark, forest):
    """The candidates are those of Python's own regular expressions."""
    out = secret_scan.scan(spark.read.parquet(f"{SF_DIR}/documents.parquet"), forest).collect()
    want = Counter((i, m.start(), len(m.group())) for i, t in texts(spark) for m in regex.finditer(secret_scan.CANDIDATE, t or ""))
    assert Counter((r.doc_id, r.start, r.n_chars) for r in out) == want


# -- toxicity


def test_toxicity_on_held_out_labels(spark):
    sf_dir = "/root/testdata/sf0.1"  # the smaller ones hold six toxic documents out
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    out = toxicity.toxicity(docs, labels)
    rows = out.join(labels, "doc_id").select("doc_id", "held_out", "score", "predicted", "toxic").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    own = [r for r in rows if r.held_out and r.toxic is not None]
    pos, neg = [r.score for r in own if r.toxic == 1], [r.score for r in own if r.toxic == 0]
    area = np.mean([(p > n) + 0.5 * (p == n) for p in pos for n in neg])
    assert area >= 0.95
    assert np.mean([r.predicted == r.toxic for r in own]) >= 0.95


def labelled_texts():
    """Texts of a few words; one pair of ordinary words stands together in toxic texts only."""
    rng, rows, labels = np.random.default_rng(5), [], []
    for i in range(400):
        toxic = i % 3 == 0
        words = [f"word{chr(97 + x)}" for x in rng.integers(0, 20, 30)] + [f"rare{chr(97 + i % 26)}{chr(97 + i // 26)}"]
        for at in rng.choice(28, 3, replace=False):
            words[at : at + 2] = ["blue", "goat"] if toxic and i % 2 else ["goat", "blue"]
        if toxic and not i % 2:
            words[5] = "scum"
        rows.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    return rows, labels


def slow_models(rows, labels):
    """For each of STRENGTHS: the log ratio of every word of a text, by the formulas and without any table of keys."""
    of = lambda t: re.findall(r"[a-z]+", t)
    own = {y: list(dict.fromkeys(t for (i, t), (_, label) in zip(rows, labels, strict=True) if label == y and zlib.crc32(str(i).encode()) % 5 in (1, 2, 3))) for y in (0, 1)}

    def firsts(t):
        words, pairs, singles = ["", "", *of(t)], {}, {}
        for x, v, w in zip(words, words[1:], words[2:], strict=False):
            pairs.setdefault((v, w), x)
            singles.setdefault(w, v)
        return pairs.items(), singles.items()

    n = {y: Counter(p for p, _ in {f for t in own[y] for f in firsts(t)[0]}) for y in (0, 1)}
    u = {y: Counter(w for w, _ in {f for t in own[y] for f in firsts(t)[1]}) for y in (0, 1)}
    everywhere = Counter(w for _, t in rows for w in set(of(t)))
    share = {w: k / sum(everywhere.values()) for w, k in everywhere.items()}
    base = [np.mean([toxicity.discount([sum(c == k for c in table[y].values()) for k in (1, 2, 3, 4)]) for y in (0, 1)]) for table in (n, u)]
    found = []
    for s, t in toxicity.STRENGTHS:
        d, e = s * base[0], t * base[1]

        def likelihood(y, v, w, d=d, e=e):
            total = sum(u[y].values())
            low = max(u[y][w] - e, 0) / total + sum(min(k, e) for k in u[y].values()) / total * share[w]
            after = [k for (x, _), k in n[y].items() if x == v]
            if not after:
                return low
            return max(n[y][v, w] - d, 0) / sum(after) + sum(min(k, d) for k in after) / sum(after) * low

        found.append(lambda text, p=likelihood: [np.log(p(1, v, w) / p(0, v, w)) for v, w in zip(["", *of(text)], of(text), strict=False)])
    return found


def test_models_against_a_slow_one(spark):
    rows, labels = labelled_texts()
    judge = toxicity.train(frame(spark, rows), spark.createDataFrame(labels, "doc_id long, toxic int"))
    asked = [t for _, t in rows[:40]]
    got = [judge.model.ratios(toxicity.word_keys(t)) for t in asked]
    assert any(all(np.allclose(g, slow(t), atol=1e-9) for g, t in zip(got, asked, strict=True)) for slow in slow_models(rows, labels))
    assert judge.margin("worda blue goat wordb") > judge.margin("worda goat blue wordb")
    assert judge.margin("worda scum wordb") > judge.margin("worda wordc wordb") and judge.margin("") == judge.margin(None) == 0


def passages_of_both_kinds():
    """Long texts; half of them hold a toxic word in sixty, and passages of words of their own stand in both kinds alike.

    Some passages are in about 5 counted texts of either kind, some in 10, some in 19: counts at each of the discounts.
    """
    rng, rows, labels = np.random.default_rng(7), [], []
    name = lambda k: "".join(chr(97 + int(x)) for x in str(k))
    often = np.repeat([5.0, 9.5, 19.0], [58, 32, 16])
    passages = [[f"pass{name(p)}x{name(x)}" for x in range(6)] for p in range(len(often))]
    for i in range(3000):
        toxic, n = i % 2 == 0, int(rng.integers(80, 500))
        words = [f"word{name(x)}" for x in rng.integers(0, 400, n)]
        for at in rng.integers(0, n, max(1, n // 60) if toxic else 0):
            words[at] = ("scum", "trash", "moron", "idiot", "loser")[int(rng.integers(5))]
        at = int(rng.integers(0, n))
        words[at:at] = passages[int(rng.choice(len(often), p=often / often.sum()))]
        rows.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    return rows, labels


def test_passages_that_both_classes_share_say_nothing(spark):
    """Counts of a passage that lie on both sides of a discount made it a thousand times likelier in one class."""
    rows, labels = passages_of_both_kinds()
    out = toxicity.toxicity(frame(spark, rows), spark.createDataFrame(labels, "doc_id long, toxic int")).where("held_out").collect()
    toxic = dict(labels)
    assert np.mean([r.predicted for r in out if toxic[r.doc_id]]) >= 0.99
    assert np.mean([r.predicted for r in out if not toxic[r.doc_id]]) <= 0.01


def test_agreed_ratios():
    assert toxicity.agreed([np.array([7.0, -2.0, 3.0, 0.0]), np.array([0.5, -4.0, -1.0, 2.0])]).tolist() == [0.5, -2.0, 0.0, 0.0]


def test_power_means():
    r = np.array([-1.0, 0.5, 2.0])
    assert np.allclose(toxicity.power_means(r), [r.mean(), *[np.log(np.exp(p * r).mean()) / p for p in (1, 2, 4)]])


# -- sharding


def brute_shards(rows, limit):
    bits = {i: f"{int(hashlib.md5(('' if i is None else str(i)).encode()).hexdigest()[:15], 16):060b}" for i, _ in rows}
    size = {k: len((t or "").encode()) for k, (_, t) in enumerate(rows)}
    out = {}

    def split(prefix, own):
        total = sum(size[k] for k in own)
        if total <= limit or len(prefix) == 60:
            out.update({k: (rows[k][0], size[k], len(prefix), prefix, total, len(own)) for k in own})
        else:
            for b in "01":
                if part := [k for k in own if bits[rows[k][0]].startswith(prefix + b)]:
                    split(prefix + b, part)

    split("", list(range(len(rows))))
    return sorted(out.values(), key=repr)


@pytest.mark.parametrize("limit", [10**9, 20_000, 300])
def test_shards_against_brute_force(spark, limit):
    rows = [*texts(spark), (None, "x" * 50), (7_000_000, None)]
    out = sharding.shards(frame(spark, rows), limit).collect()
    assert sorted(((r.doc_id, r.n_bytes, r.local_depth, r.shard, r.shard_bytes, r.shard_rows) for r in out), key=repr) == brute_shards(rows, limit)


def test_shards_written_hold_every_row(spark, tmp_path):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    sharding.write_shards(docs, f"file://{tmp_path}/out", 50_000)
    back = spark.read.parquet(f"file://{tmp_path}/out/rows")
    assert Counter(map(tuple, back.select(*docs.columns).collect())) == Counter(map(tuple, docs.collect()))
    sizes = back.groupBy("shard").agg(F.sum(F.octet_length("text")).alias("n"), F.count("*").alias("rows")).collect()
    assert all(r.n <= 50_000 or r.rows == 1 for r in sizes)


def test_shards_of_a_table_with_clashing_names(spark):
    rows = [*EDGE, *[(k, f"text {k} " * (k % 50)) for k in range(300)]]
    plain = sorted(map(tuple, sharding.shards(frame(spark, rows), 3000).collect()), key=repr)
    assert sorted(map(tuple, sharding.written_shards(frame(spark, rows), 3000).collect()), key=repr) == plain
    assert sharding.written_shards(frame(spark, []), 3000).count() == 0


# -- pipeline


def test_pipeline_stage_by_stage(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    steps, before = dict(corpus_pipeline.STAGES), docs
    assert list(steps) == ["toxicity", "exact_dedup", "simhash_near_dedup", "secret_scan", "packing"]
    rows = {}
    for name, stage in list(steps.items())[:4]:
        before = stage(spark, before, SF_DIR)
        assert before.columns == docs.columns
        rows[name] = {r.doc_id: r.text for r in before.collect()}
    labels = spark.read.parquet(f"{SF_DIR}/labels.parquet")
    clean = {r.doc_id for r in toxicity.toxicity(docs, labels).where("predicted = 0").collect()}
    assert set(rows["toxicity"]) == clean
    best = defaultdict(int)
    for i, t in rows["toxicity"].items():
        key = (t or "").translate(str.maketrans(exact_dedup.UPPER, exact_dedup.LOWER))
        best[key] = max(best[key], i)
    assert set(rows["exact_dedup"]) == set(best.values())
    # of each group that similarities of 0.8 and more join, the smallest id stays
    sets = {i: set(simhash.shingles(t, 5).tolist()) for i, t in rows["exact_dedup"].items()}
    linked = all_links([(i, x) for i, x in sets.items() if x], lambda x, y: len(x & y) >= 0.8 * len(x | y))
    group = components(list(sets), linked)
    kept = rows["simhash_near_dedup"]
    assert linked and set(kept) == {i for i in sets if group[i] == i}
    assert set(rows["secret_scan"]) == set(kept)
    assert any("[SECRET]" in (t or "") for t in rows["secret_scan"].values()) or rows["secret_scan"] == kept
    out = packing.pack(before, tokenizer("byte_bpe_50k.json"), 1).collect()
    ran = corpus_pipeline.run(spark, SF_DIR).collect()
    assert Counter((r.doc_id, r.doc_tokens) for r in ran if r.start == 0) == Counter((r.doc_id, r.doc_tokens) for r in out if r.start == 0)
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(tokenizer("byte_bpe_50k.json"))
    assert {r.doc_id: r.doc_tokens for r in ran} == {i: len(tok.encode(t or "", add_special_tokens=False).ids) + 1 for i, t in rows["secret_scan"].items()}
