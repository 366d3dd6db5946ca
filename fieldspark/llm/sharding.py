"""Sharding by extendible hashing.

A row's bucket is a prefix of the bits of its key's hash.  The directory
starts with one bucket of no bits; a bucket whose rows exceed the byte limit,
and only such a bucket, splits on one more bit, until every bucket fits.  The
directory is found from a histogram of hash prefixes, not from the rows, and
rows meet it by an equi-join on their prefix.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import Scratch, new_path, scratched, small_side, write_and_read

#: Bits that a hash has; a bucket that is still too large with all of them holds one key, or its rows are too large themselves.
BITS = 60


def hash_bits(key: Column) -> Column:
    """The first 60 bits of the MD5 of the key as text, as a long."""
    return F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), 1, 15), 16, 10).cast("long")


def shard_name(bits: Column, depth: Column | int) -> Column:
    """The bits of a bucket as text; '' where it has none."""
    return F.when(F.lit(depth) == 0, "").otherwise(F.lpad(F.bin(bits), F.lit(depth).cast("int"), F.lit("0")))


@scratched
def shards(scratch: Scratch, docs: DataFrame, limit: int, id_col: str = "doc_id", text_col: str = "text", step: int = 8) -> DataFrame:
    """One row for each row of docs: doc_id, n_bytes, local_depth, shard, shard_bytes, shard_rows.

    A row has the bytes of its UTF-8 text (null: 0); its key is its id (null
    like an empty one).  shard is the bits of the bucket as text ('' where all
    rows fit in one).  No shard exceeds limit, but those whose rows all share
    one key, such as a single document that is larger by itself.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long").alias("n_bytes"))
    rows = scratch.table(rows.withColumn("h", hash_bits(F.col("doc_id"))), "rows")
    # equal hashes cannot be split: one row for each, summed before the shuffle
    open_cells = rows.groupBy("h").agg(F.sum("n_bytes").alias("bytes"), F.count("*").alias("rows")).select("h", "bytes", "rows", F.lit(0).alias("depth"))
    open_cells = scratch.table(open_cells, "hashes")
    final = None
    for base in range(0, BITS, step):
        # step levels at a time: all prefixes of each histogram cell at once
        last = base + step >= BITS
        width = min(step, BITS - base)
        prefix = F.shiftright("h", BITS - base - width).alias("p")
        cells = open_cells.groupBy(prefix).agg(F.sum("bytes").alias("bytes"), F.sum("rows").alias("rows"))
        levels = cells.select("*", F.explode(F.sequence(F.lit(0), F.lit(width))).alias("up"))
        sums = levels.groupBy("up", F.expr("shiftright(p, up)").alias("b")).agg(F.sum("bytes").alias("bytes"), F.sum("rows").alias("rows"))
        fits = sums.where((F.col("bytes") <= limit) | ((F.col("up") == 0) & F.lit(last)))
        # of the buckets that fit, those whose parent does not
        parent = sums.where(F.col("bytes") > limit).select((F.col("up") - 1).alias("up"), F.col("b").alias("parent"))
        split = fits.join(parent, (fits.up == parent.up) & (F.expr("shiftright(b, 1)") == F.col("parent")), "left_semi")
        if base == 0:
            split = split.unionByName(fits.where(F.col("up") == width))
        buckets = split.select((F.lit(base + width) - F.col("up")).alias("local_depth"), F.col("b").alias("bits"), F.col("bytes").alias("shard_bytes"), F.col("rows").alias("shard_rows"))
        buckets = scratch.table(buckets, "buckets")
        final = buckets if final is None else final.unionByName(buckets)
        too_large = scratch.table(sums.where((F.col("up") == 0) & (F.col("bytes") > limit)).select(F.col("b").alias("p")), "too-large")
        if last or too_large.isEmpty():
            break
        open_cells = scratch.table(open_cells.withColumn("p", F.shiftright("h", BITS - base - width)).join(too_large, "p", "left_semi").drop("p"), "open")
    depths = [r.local_depth for r in final.select("local_depth").distinct().collect()]  # BITS + 1 values at most
    tried = F.array(*[F.struct(F.lit(d).alias("local_depth"), F.shiftright("h", BITS - d).alias("bits")) for d in sorted(depths)]) if depths else F.array()
    hashes = rows.select("h").distinct().select("h", F.explode(tried).alias("t")).select("h", "t.*") if depths else None
    if hashes is None:
        out = rows.select("doc_id", "n_bytes", *[F.lit(None).cast("long").alias(c) for c in ("local_depth", "shard", "shard_bytes", "shard_rows")])
    else:
        placed = scratch.table(hashes.join(final, ["local_depth", "bits"]), "placed")
        named = shard_name(F.col("bits"), F.col("local_depth"))
        out = rows.join(placed, "h").select("doc_id", "n_bytes", F.col("local_depth").cast("long").alias("local_depth"), named.alias("shard"), "shard_bytes", "shard_rows")
    return write_and_read(out, new_path(docs.sparkSession, "shards"))


def directory(found: DataFrame) -> DataFrame:
    """The directory of the shards that rows of ``shards`` lie in: shard, local_depth, shard_bytes, shard_rows.

    A later batch finds its bucket by the longest prefix of its hash that
    stands here; the global depth is the largest local_depth.
    """
    return found.select("shard", "local_depth", "shard_bytes", "shard_rows").distinct()


def folder_column(columns: list[str]) -> str:
    """shard, with underscores behind it while a column of the table has that name."""
    name, taken = "shard", {c.lower() for c in columns}
    while name in taken:
        name += "_"
    return name


def in_shards(docs: DataFrame, listed: DataFrame, name: str, id_col: str = "doc_id") -> DataFrame:
    """docs with b and its shard as column name: a row finds it by the prefixes of its own hash in listed (shard, local_depth), and does not move for it."""
    depths = sorted(r.local_depth for r in listed.select("local_depth").distinct().collect())  # BITS + 1 values at most
    rows = docs.withColumn("__llm_hash", hash_bits(F.col(id_col).cast("long")))
    tried = F.array(*[shard_name(F.shiftright("__llm_hash", BITS - d), d) for d in depths]).cast("array<string>")
    rows = rows.withColumn("__llm_shard", F.explode(tried)).drop("__llm_hash")
    there = small_side(listed.select(F.col("shard").alias("__llm_shard")))
    return rows.join(there, "__llm_shard").withColumn(name, F.concat(F.lit("b"), "__llm_shard")).drop("__llm_shard")


def write_shards(docs: DataFrame, path: str, limit: int, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Writes docs below path: ``rows`` has one folder shard=b... for each shard, all columns as they were; ``directory`` the directory.

    Where docs has a column shard itself, folders are named shard_= instead.
    Rows with a null id, and rows that repeat one, go where their id belongs.
    """
    spark, name = docs.sparkSession, folder_column(docs.columns)
    write_and_read(directory(shards(docs, limit, id_col, text_col)), f"{path}/directory")
    listed = spark.read.parquet(f"{path}/directory").select("shard", "local_depth")
    joined = in_shards(docs, listed, name, id_col)
    joined.repartition(name).write.partitionBy(name).option("compression", "zstd").parquet(f"{path}/rows")


def written_shards(docs: DataFrame, limit: int, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Writes the shards and says what their files hold: doc_id, n_bytes, local_depth, shard, shard_bytes, shard_rows.

    All of it is read back; a shard whose rows or bytes are not those of the
    directory fails the job.  A null text has no bytes; a text longer than the
    limit, and rows that share a doc_id, make a shard that no split makes
    smaller.  An empty table gives an empty one.
    """
    spark = docs.sparkSession
    path = path or new_path(spark, "sharded")
    write_shards(docs, path, limit, id_col, text_col)
    name = folder_column(docs.columns)
    if docs.isEmpty():  # no folder has been written
        return shards(docs, limit, id_col, text_col)
    read = spark.read.schema(docs.schema.add(name, "string")).parquet(f"{path}/rows")
    rows = read.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long").alias("n_bytes"), F.expr(f"substring({name}, 2)").alias("shard"))
    sums = rows.groupBy("shard").agg(F.sum("n_bytes").alias("bytes"), F.count("*").alias("rows"))
    listed = spark.read.parquet(f"{path}/directory").join(sums, "shard", "full")
    same = (F.col("bytes") == F.col("shard_bytes")) & (F.col("rows") == F.col("shard_rows"))
    wrong = F.raise_error(F.lit("a shard's files are not what the directory says")).cast("long")
    listed = listed.select("shard", "local_depth", F.when(same, F.col("bytes")).otherwise(wrong).alias("shard_bytes"), F.col("rows").alias("shard_rows"))
    out = rows.join(listed, "shard").select("doc_id", "n_bytes", "local_depth", "shard", "shard_bytes", "shard_rows")
    return write_and_read(out, new_path(spark, "shard-rows"))
