"""A corpus pipeline: toxic documents out, copies out, near copies out, secrets masked, the rest packed.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is
written as Parquet and read again as the docs of the next.

All stages take nulls in any column, empty and very long texts, repeated rows
and further columns of any name; an empty table goes through as one.  A null
text is empty.  Equal texts, null and empty ones among them, are one document
after exact dedup; rows without an id or a word are no near copies of any.
Ids may repeat: rows of one id are told apart by their texts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from fieldspark.llm import exact_dedup, packing, secret_scan, simhash, toxicity
from fieldspark.llm.queries import tokenizer
from fieldspark.llm.storage import new_path, write_and_read


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 7: documents predicted toxic go."""
    return toxicity.without_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 10: of equal texts the largest doc_id stays."""
    return exact_dedup.keep_first(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 6: of each group of near copies the smallest doc_id stays; five words, similarity of 0.8 and more."""
    return simhash.keep_near(docs)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 5: secrets in texts are masked; every document stays."""
    return secret_scan.redacted(docs)


def pack_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 9: what is left, as sequences of at most 2048 ids."""
    return packing.pack(docs, tokenizer("byte_bpe_50k.json"), 1)


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_copies),
    ("simhash_near_dedup", drop_near_copies),
    ("secret_scan", mask_secrets),
    ("packing", pack_documents),
]

#: The forest, the models and the tokenizer are not SQL; tests compare each stage with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = write_and_read(stage(spark, docs, sf_dir), new_path(spark, f"stage-{name}"))
    return docs
