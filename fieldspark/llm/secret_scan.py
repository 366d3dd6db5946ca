"""Secret scanning: candidates by pattern, false positives removed by a random forest.

The forest judges a candidate by its length, the transitions between kinds of
characters, the share of it that dictionary words cover, the path it comes
from and the words beside it.  It is trained on labelled findings with
Spark's own random forest, then written out as a column expression, so that
scanning is one pass of built-in functions over each text: no Python, no
join, no shuffle.
"""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TOKEN = "A-Za-z0-9_+/=~-"
#: A whole run of token characters with a digit anywhere in it, or a block of a private key, headers and all.  Neither has
#: a greatest length; the quantifiers are possessive, so a long run costs one pass.
KEY_BLOCK = r"-----BEGIN [A-Z0-9 ]*?PRIVATE KEY(?: BLOCK)?-----\s*(?:[A-Za-z][A-Za-z-]*:[^\r\n]*[\r\n]+)*+[A-Za-z0-9+/=\s]*-----END [A-Z0-9 ]*?PRIVATE KEY(?: BLOCK)?-----"
RUN = rf"(?<![{TOKEN}])(?=[A-Za-z_+/=~-]*+[0-9])[{TOKEN}]{{16,}}+"
#: What a key word assigns, of six characters and more, with or without a digit.
ASKED = r"(?i:passw(?:or)?d|passphrase|pwd|secret|token|api[_-]?key|access[_-]?key|private[_-]?key|credential)s?[\"']?[ \t]{0,2}"
ASSIGNS = rf"{ASKED}(?:=>|:=|[:=])[ \t]{{0,2}}[\"']?"
#: Whether a text assigns to a key word at all: looks back at the signs only.
GATE = rf"[:=](?<={ASKED}[:=])"
VALUE = rf"(?<={ASSIGNS})[^\s\"'<>,;]{{5,}}[^\s\"'<>,;.)\]}}]"
CANDIDATE = f"{KEY_BLOCK}|{VALUE}|{RUN}"
#: The same where a text assigns nothing to a key word: without a look-behind at each character.
PLAIN = f"{KEY_BLOCK}|{RUN}"
ASKS = "token|secret|passw|pwd|api.?key|apikey|access.?key|auth|credential|private|bearer|signing"
INNOCENT = "commit|sha|md5|hash|checksum|digest|uuid|guid|etag|revision|order|card|account|phone|isbn|serial|build|version|trace"
KNOWN = "^(AKIA|ASIA|ghp_|gho_|github_pat_|glpat-|xox[abp]-|sk_live_|sk-|AIza|eyJ|npm_|-----BEGIN)"
#: Words that code and prose use inside long names.
DICTIONARY = "access|account|action|address|array|async|backup|base|block|buffer|build|button|bytes|cache|call|channel|check|class|client|code|color|column|command|config|connect|content|count|create|data|date|debug|default|delete|detail|device|document|domain|element|email|engine|error|event|example|factory|field|file|filter|format|function|group|handler|header|height|image|index|input|item|label|layout|length|level|list|local|login|manager|message|method|model|module|name|network|number|object|option|order|output|page|panel|param|parse|path|pattern|phone|place|player|point|print|process|product|project|query|queue|random|record|remote|render|report|request|result|return|row|sample|schema|screen|search|select|server|service|session|shape|size|source|start|state|status|store|stream|string|style|system|table|target|task|template|test|text|thread|time|title|total|type|update|user|value|vector|version|view|widget|width|window|worker|write"
#: Characters of context on either side that are looked at.
CONTEXT = 48
FEATURES = ["length", "letter_to_digit", "case_changes", "punctuation", "digit_share", "upper_share", "vowel_share", "distinct_share", "hex_only", "covered", "known_form", "asks", "innocent", "assigned", "quoted", "placeholder", "example_path", "looks_grouped", "refers"]


def features(candidate: Column, before: Column, after: Column, path: Column) -> list[Column]:
    """The columns of FEATURES, all doubles."""

    def count(pattern: str) -> Column:
        return F.length(candidate) - F.length(F.regexp_replace(candidate, pattern, ""))

    def says(where: Column, pattern: str) -> Column:
        return F.when(where.rlike(pattern), 1.0).otherwise(0.0)

    def breaks(pattern: str) -> Column:
        return F.length(F.regexp_replace(candidate, pattern, "#")) - F.length(candidate)

    n = F.greatest(F.length(candidate), F.lit(1))
    left, right = F.lower(F.coalesce(before, F.lit(""))), F.coalesce(after, F.lit(""))
    letters = F.greatest(count("[A-Za-z]"), F.lit(1))
    out = [
        F.least(n, F.lit(200)),
        breaks("(?<=[A-Za-z])(?=[0-9])") / n,
        breaks("(?<=[a-z])(?=[A-Z])|(?<=[A-Z])(?=[a-z])") / n,
        count("[^A-Za-z0-9]") / n,
        count("[0-9]") / n,
        count("[A-Z]") / n,
        count("[aeiouAEIOU]") / letters,
        F.size(F.array_distinct(F.split(F.substring(candidate, 1, 64), ""))) / F.least(n, F.lit(64)),
        says(candidate, "^([0-9a-f]+|[0-9A-F]+)$"),
        count(f"(?i){DICTIONARY}") / n,
        says(candidate, KNOWN),
        says(left, f"({ASKS})[a-z_ -]{{0,12}}[\"']?\\s{{0,3}}(:|=|=>|is)?\\s{{0,3}}[\"']?$"),
        says(left, f"({INNOCENT})[a-z_ -]{{0,12}}[\"']?\\s{{0,3}}(:|=|=>|is)?\\s{{0,3}}[\"']?$"),
        says(left, "[:=]\\s{0,3}[\"']?$"),
        says(F.concat(F.substring(left, -1, 1), F.substring(right, 1, 1)), "^(\"\"|'')$"),
        says(F.lower(candidate), "x{4}|0{6}|1234567|abcdef0|example|changeme|placeholder|your[_-]|required|optional|undefined"),
        says(F.lower(F.coalesce(path, F.lit(""))), "test|example|fixture|sample|docs?/|vendor|lock|mock"),
        says(candidate, "^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-|^[0-9]+$|^[0-9]+[-/][0-9-/]+$|^[a-z]+([_-][a-z]+)+[0-9]*$"),
        says(candidate, "[({\\[]|^[$%]|^[a-z_]+([.][a-zA-Z_]+)+$"),
    ]
    return [c.cast("double") for c in out]


def labelled_findings(spark: SparkSession, rows: int = 6000) -> DataFrame:
    """Labelled findings made by rule, the same each time: before, candidate, after, path, label.

    They stand in where no reviewed findings are at hand; train takes any
    DataFrame of these columns.
    """
    i, h = F.col("id"), F.sha2(F.col("id").cast("string").cast("binary"), 256)
    g = F.sha2(F.concat(F.lit("b"), F.col("id").cast("string")).cast("binary"), 512)
    b64 = F.regexp_replace(F.base64(F.unhex(g)), "\\s", "")

    def pick(salt: str, *values) -> Column:
        return F.element_at(F.array(*[F.lit(v) for v in values]), (F.pmod(F.xxhash64(F.lit(salt), i), F.lit(len(values))) + 1).cast("int"))

    def sub(c: Column, n: int) -> Column:
        return F.substring(c, 1, n)

    prose = pick("p", "the and of ", "in that was on ", "der die und ", "le la de que ", "el los en con ", "see also ", "\n", "value, ", "| ", "!! ")
    asks = pick("k", "token", "secret", "password", "api_key", "access_key", "auth_token", "client_secret", "PRIVATE_TOKEN", "credential", "Token", "SECRET_KEY", "pwd")
    equals = pick("e", " = \"", "=\"", ": \"", "=", ": ", " = '", " = ", "=> \"")
    innocent = pick("n", "commit ", "sha256: ", "md5 = ", "checksum: ", "etag=\"", "revision ", "digest \"", "uuid: ", "build ", "trace id ", "hash = \"")
    plain = pick("q", "order ", "card ", "", "number ", "account: ", "phone ", "id = ", "in ", "and ")
    uuid = F.concat_ws("-", sub(h, 8), F.substring(h, 9, 4), F.substring(h, 13, 4), F.substring(h, 17, 4), F.substring(h, 21, 12))
    digits = F.substring(F.regexp_replace(F.concat(h, g), "[^0-9]", ""), 1, 24)
    name = F.concat_ws("_", pick("w1", "user", "request", "session", "document", "template", "message"), pick("w2", "manager", "handler", "factory", "buffer", "status", "index"), pick("w3", "test", "value", "config", "count", "v2", "item3"), F.pmod(i, F.lit(1000)).cast("string"))
    # by a hash: the kinds below go by the number itself, and a length must not tell them apart
    hexes = F.substring(F.concat(h, g), F.lit(1), pick("l", 40, 40, 40, 32, 32, 64, 128))
    kinds = [
        (1, F.concat(prose, asks, equals), hexes), (1, F.concat(prose, asks, equals), sub(b64, 40)), (1, F.concat(prose, pick("v", "", "key ", "aws ")), F.concat(F.lit("AKIA"), sub(F.upper(h), 16))),
        (1, F.concat(prose, pick("v", "", "use ", "token ")), F.concat(pick("t", "ghp_", "glpat-", "sk_live_", "npm_"), sub(F.regexp_replace(b64, "[+/=]", "Q"), 36))), (1, F.concat(prose, asks, equals), F.upper(hexes)), (1, F.concat(prose, asks, equals), F.concat(sub(b64, 20), F.lit("="))),
        (0, F.concat(prose, innocent), hexes), (0, F.concat(prose, innocent), uuid), (0, F.concat(prose, plain), F.substring(digits, 1, 16)), (0, F.concat(prose, plain), name), (0, prose, hexes), (0, F.concat(prose, asks, equals), pick("x", "xxxxxxxxxxxx0000", "your_token_here_1", "EXAMPLE0000000000", "changeme12345678", "00000000000000000000")),
        (0, F.concat(prose, F.lit("https://host/")), F.concat(name, F.lit("/"), sub(h, 8))), (0, F.concat(prose, plain), F.concat(sub(digits, 4), F.lit("-"), F.substring(digits, 5, 4), F.lit("-"), F.substring(digits, 9, 8))),
    ]
    # what a key word assigns: passphrases and short values, and the words and references that stand there as well
    phrase = F.call_function("array_join", F.array(*[pick(f"a{k}", "Correct", "Horse", "Battery", "Staple", "Winter", "Orange", "Velvet", "Thunder", "Copper", "Meadow", "Falcon", "Granite") for k in range(4)]), pick("j", "-", "-", "_", "."))
    letters = F.regexp_replace(b64, "[^A-Za-z]", "")
    word = F.concat(pick("o", "required", "optional", "nothing", "should", "because", "always", "expired", "missing", "hidden", "revoked", "invalid", "everyone"), pick("o2", "", "", "ly", "-only"))
    refers = F.concat(pick("r1", "self.", "config.", "os.environ[", "get_token(", "${", "request.headers.", "settings."), pick("r2", "token", "secret_key", "password", "value", "API_KEY", "auth_value"))
    short = F.concat(F.substring(b64, F.lit(1), pick("l2", 7, 8, 9, 11)), pick("m", "!", "#", "@", "9", "$7"))
    kinds += [(1, F.concat(prose, asks, equals), phrase), (1, F.concat(prose, asks, equals), F.substring(letters, F.lit(1), pick("l3", 12, 20, 32))), (1, F.concat(prose, asks, equals), short), (0, F.concat(prose, asks, equals), word), (0, F.concat(prose, asks, equals), refers)]
    n = len(kinds)
    chosen = [F.when(i % n == k, F.struct(F.lit(float(y)).alias("label"), b.alias("before"), c.alias("candidate"))) for k, (y, b, c) in enumerate(kinds)]
    out = spark.range(rows).select("id", F.coalesce(*chosen).alias("f"))
    quote = F.when(F.col("f.before").rlike("\"$"), "\"").when(F.col("f.before").rlike("'$"), "'").otherwise("")
    return out.select("f.before", "f.candidate", F.concat(quote, pick("a", " the", "\n", " and", ".", ",", "###", "!!", " |", "")).alias("after"), pick("path", "src0", "src7", "web/page", "app/main.py", "docs/guide", "tests/fixture", "forum").alias("path"), "f.label")


def train(findings: DataFrame, trees: int = 30, depth: int = 8, seed: int = 11, max_rows: int = 50_000) -> RandomForestClassificationModel:
    """A random forest from labelled findings, at most max_rows of them (those with the least hash)."""
    bounded = findings.orderBy(F.xxhash64("candidate", "before"), "candidate").limit(max_rows)
    made = features(F.col("candidate"), F.col("before"), F.col("after"), F.col("path"))
    rows = bounded.select("label", *[c.alias(n) for c, n in zip(made, FEATURES, strict=True)])
    rows = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(rows).select("label", "features")
    return RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed, subsamplingRate=0.8, featureSubsetStrategy="sqrt").fit(rows)


def as_column(model: RandomForestClassificationModel, f: Column) -> Column:
    """The share of secret among the leaves that the array f of features reaches, as an expression."""

    def walk(node) -> Column:
        if node.getClass().getSimpleName() == "LeafNode":
            stats = list(node.impurityStats().stats())
            return F.lit(float(stats[1] / max(sum(stats), 1e-9)) if len(stats) > 1 else 0.0)
        split = node.split()
        return F.when(f[split.featureIndex()] <= F.lit(float(split.threshold())), walk(node.leftChild())).otherwise(walk(node.rightChild()))

    votes = [walk(t._java_obj.rootNode()) for t in model.trees]
    total = votes[0]
    for v in votes[1:]:
        total = total + v
    return total / F.lit(float(len(votes)))


def scanned(docs: DataFrame, model: RandomForestClassificationModel, text_col: str = "text", path_col: str = "source") -> DataFrame:
    """docs with __llm_gaps (the text between candidates) and __llm_found: candidate, start, score of each, in order."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    some, assigns = text.rlike("[0-9]|-----BEGIN"), text.rlike(GATE)
    hits = F.when(assigns, F.regexp_extract_all(text, F.lit(CANDIDATE), F.lit(0))).when(some, F.regexp_extract_all(text, F.lit(PLAIN), F.lit(0))).otherwise(F.array().cast("array<string>"))
    out = docs.withColumn("__llm_hits", hits)
    gaps = F.when(F.size("__llm_hits") == 0, F.array(text)).when(assigns, F.split(text, CANDIDATE, -1)).otherwise(F.split(text, PLAIN, -1))
    out = out.withColumn("__llm_gaps", gaps)
    path = F.col(path_col) if path_col in docs.columns else F.lit("")
    lengths = F.zip_with(F.slice("__llm_gaps", 1, F.size("__llm_hits")), "__llm_hits", lambda g, c: F.struct(F.length(g).alias("g"), F.length(c).alias("c")))
    # a running sum of the lengths before each candidate
    ends = F.aggregate(lengths, F.array(F.lit(0)), lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + x["g"] + x["c"])))
    out = out.withColumn("__llm_ends", F.when(F.size("__llm_hits") > 0, ends))
    seen = F.transform("__llm_hits", lambda c, k: F.struct(c.alias("candidate"), (F.element_at("__llm_ends", k + 2) - F.length(c)).alias("start"), F.array(*features(c, F.right(F.element_at("__llm_gaps", k + 1), F.lit(CONTEXT)), F.left(F.element_at("__llm_gaps", k + 2), F.lit(CONTEXT)), path)).alias("f")))
    out = out.withColumn("__llm_seen", seen)
    scored = F.transform("__llm_seen", lambda x: F.struct(x["candidate"].alias("candidate"), x["start"].alias("start"), as_column(model, x["f"]).alias("score")))
    return out.withColumn("__llm_found", scored).drop("__llm_hits", "__llm_ends", "__llm_seen")


def scan(docs: DataFrame, model: RandomForestClassificationModel | None = None, threshold: float = 0.5, id_col: str = "doc_id", text_col: str = "text", path_col: str = "source") -> DataFrame:
    """One row for each candidate: doc_id, start (in characters), n_chars, candidate_sha256, score, is_secret.

    Candidates are whole blocks of private keys, whole runs of 16 and more
    token characters with a digit, and whole values of six and more characters
    that a key word assigns; none has a greatest length.  An empty table gives
    an empty one.  Null and empty texts have none.  Rows with a null doc_id are scanned like
    others.  Repeated rows each have their own findings.
    """
    model = model or train(labelled_findings(docs.sparkSession))
    found = scanned(docs, model, text_col, path_col).where(F.size("__llm_found") > 0)
    found = found.select(F.col(id_col).cast("long").alias("doc_id"), F.explode("__llm_found").alias("x"))
    return found.select("doc_id", F.col("x.start").cast("long").alias("start"), F.length("x.candidate").cast("long").alias("n_chars"), F.sha2(F.col("x.candidate").cast("binary"), 256).alias("candidate_sha256"), F.round("x.score", 9).alias("score"), (F.col("x.score") >= threshold).alias("is_secret"))


def redacted(docs: DataFrame, model: RandomForestClassificationModel | None = None, threshold: float = 0.5, text_col: str = "text", path_col: str = "source", mark: str = "[SECRET]") -> DataFrame:
    """docs with mark in place of each secret; other columns and texts as they were (n_chars follows the text, if there)."""
    model = model or train(labelled_findings(docs.sparkSession))
    out = scanned(docs, model, text_col, path_col)
    parts = F.zip_with("__llm_gaps", "__llm_found", lambda g, x: F.concat(g, F.when(x.isNull(), "").when(x["score"] >= threshold, mark).otherwise(x["candidate"])))
    hit = F.exists("__llm_found", lambda x: x["score"] >= threshold)
    out = out.withColumn(text_col, F.when(hit, F.array_join(parts, "")).otherwise(F.col(text_col)))
    if "n_chars" in docs.columns and text_col == "text":
        out = out.withColumn("n_chars", F.when(hit, F.length(text_col).cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)
