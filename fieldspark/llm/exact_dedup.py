"""Exact deduplication against a persistent digest index.

The index is a Parquet table bucketed and sorted by digest, one row for each
text ever kept.  A batch is first reduced to one row for each of its digests
(partial sums before the shuffle, so a text that makes up a third of all rows
costs one row for each task), then reduced by a sort-merge anti-join against
the index; what is new is appended, and what stays is read from the index.
"""

from __future__ import annotations

import re
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .storage import Scratch, delete_path, new_path, partitions, scratched, shared_dir, small_side, write_and_read

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def normalised(text: Column) -> Column:
    """A-Z lower-cased, nothing else; null counts as empty."""
    return F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)


def digest_of(text: Column) -> Column:
    return F.sha2(normalised(text).cast("binary"), 256)


class DigestIndex:
    """The persistent index: digest, keep_id, batch.  A later session opens it again by its location alone.

    A location holds versions, folders ``v-<number>-of-<buckets>``; the index
    is the newest that a finished job has marked, or the first.  The number of
    buckets is fixed when the index is made: choose it for the size the index
    will reach (a bucket should stay below about 1 GB).  Each append adds a
    sorted file to each bucket, and reads of more than one file sort again:
    ``compact`` puts them together in a new version at the same location.
    One session writes to an index at a time.
    """

    def __init__(self, spark: SparkSession, name: str | None = None, buckets: int | None = None, location: str | None = None):
        self.spark, self.name = spark, name or f"digest_index_{uuid.uuid4().hex}"
        self.location = (location or f"{shared_dir(spark)}/{self.name}").rstrip("/")
        known = self._versions()
        made = {b for _, b, _ in known}
        if made and buckets and made != {buckets}:
            raise ValueError(f"the index at {self.location} has {made} buckets, not {buckets}")
        self.buckets = made.pop() if made else buckets or partitions(spark)
        # a version without the mark is the first, or what a compaction left unfinished
        ready = [n for n, _, done in known if done] or [n for n, _, _ in known][:1] or [0]
        self.version = max(ready)
        self._create(self.name, self._folder(self.version))
        self.spark.sql(f"ALTER TABLE {self.name} SET LOCATION '{self._folder(self.version)}'")  # a metastore may name an older version

    def _folder(self, version: int) -> str:
        return f"{self.location}/v-{version}-of-{self.buckets}"

    def _versions(self) -> list[tuple[int, int, bool]]:
        """Number, buckets, and whether it is marked, of each version, ascending."""
        place = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.location)
        files = place.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        if not files.exists(place):
            return []
        found = [re.fullmatch(r"v-(\d+)-of-(\d+)", s.getPath().getName()) for s in files.listStatus(place)]
        mark = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        return sorted((int(m[1]), int(m[2]), files.exists(mark(f"{self.location}/{m[0]}/_SUCCESS"))) for m in found if m)

    def _create(self, name: str, location: str) -> None:
        self.spark.sql(
            f"CREATE TABLE IF NOT EXISTS {name} (digest STRING, keep_id BIGINT, batch STRING) USING parquet "
            f"CLUSTERED BY (digest) SORTED BY (digest) INTO {self.buckets} BUCKETS LOCATION '{location}'"
        )

    def table(self) -> DataFrame:
        return self.spark.table(self.name)

    def new_of(self, groups: DataFrame) -> DataFrame:
        """Rows of groups (digest, ...) whose digest the index lacks: a sort-merge anti-join by buckets."""
        return groups.join(self.table().hint("merge"), "digest", "left_anti")

    def append(self, new: DataFrame, batch: str) -> None:
        """Adds rows (digest, keep_id) of a batch; dealt as the buckets are, so that each task writes one sorted file.

        Spark commits the files of an append together; a run that dies before that adds nothing.
        """
        new.select("digest", "keep_id", F.lit(batch).alias("batch")).repartition(self.buckets, "digest").write.insertInto(self.name)
        self.spark.catalog.refreshTable(self.name)

    def compact(self) -> None:
        """One sorted file for each bucket again, in a new version.

        The new version counts from the moment its job marks it as finished,
        and the old one goes only then: a run that dies at any point leaves
        one whole index at the location.
        """
        known = [n for n, _, _ in self._versions()]
        fresh, name = max(known, default=0) + 1, f"{self.name}_{uuid.uuid4().hex[:8]}"
        self._create(name, self._folder(fresh))
        try:
            self.table().repartition(self.buckets, "digest").write.insertInto(name)
        except Exception:
            delete_path(self.spark, self._folder(fresh))
            raise
        finally:
            self.spark.sql(f"DROP TABLE {name}")  # its files are not its own: they stay
        self.spark.sql(f"ALTER TABLE {self.name} SET LOCATION '{self._folder(fresh)}'")
        self.spark.catalog.refreshTable(self.name)
        self.version = fresh
        for old in known:
            delete_path(self.spark, self._folder(old))

    def drop(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")
        delete_path(self.spark, self.location)


@scratched
def exact_dedup(
    scratch: Scratch, docs: DataFrame, index: DigestIndex | None = None, id_col: str = "doc_id", text_col: str = "text", batch: str | None = None, batches: int = 1
) -> DataFrame:
    """One row for each row of docs: doc_id, keep_id, group_size, kept, text_sha256.

    Of the rows of equal text in docs, the largest doc_id stays, unless an
    earlier call has put the text into the index: then keep_id is that
    call's and no row stays.  docs goes to the index in the given number of
    batches, ranges of falling doc_id of like size: the anti-join against the
    index takes out of each what larger ids have brought.  keep_id is read
    from the index.  A call with a named batch may be given again after a
    failure at any point: what it has appended counts as its own, and the
    answer is the same.

    Null text equals empty text; very long texts are one digest like others.
    A null doc_id never stays while its text has a row with an id; where all
    ids of a text are null, keep_id is null and those rows stay.  Rows that
    repeat the doc_id that stays all say kept; ``keep_first`` returns one of
    them.  An empty table gives an empty one and appends nothing.
    """
    spark = docs.sparkSession
    own, batch = index or DigestIndex(spark), batch or uuid.uuid4().hex
    try:
        rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), digest_of(F.col(text_col)).alias("digest"))
        rows = scratch.table(rows, "digests")
        cuts = sorted(set(rows.approxQuantile("doc_id", [k / batches for k in range(1, batches)], 0.01))) if batches > 1 else []
        part = F.lit(0)  # rows without an id come last: any other row of their text has brought it by then
        for cut in cuts:
            part = part + F.coalesce(F.col("doc_id") > F.lit(cut), F.lit(False)).cast("int")
        groups = rows.groupBy("digest", part.alias("part")).agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("own_size"))
        groups = scratch.table(groups, "groups")
        for k in range(len(cuts), -1, -1):
            own.append(scratch.table(own.new_of(groups.where(F.col("part") == k)), "new"), batch)
        sizes = groups.groupBy("digest").agg(F.sum("own_size").alias("group_size"))
        told = sizes.join(own.table().hint("merge"), "digest")
        told = scratch.table(told.select("digest", "keep_id", "group_size", (F.col("batch") == batch).alias("fresh")), "told")
        out = rows.join(told, "digest").select(
            "doc_id",
            "keep_id",
            "group_size",
            (F.col("fresh") & F.col("doc_id").eqNullSafe(F.col("keep_id"))).alias("kept"),
            F.col("digest").alias("text_sha256"),
        )
        return write_and_read(out, new_path(spark, "exact"))
    finally:
        if index is None:
            own.drop()


@scratched
def keep_first(scratch: Scratch, docs: DataFrame, index: DigestIndex | None = None, id_col: str = "doc_id", text_col: str = "text", batch: str | None = None) -> DataFrame:
    """docs without the copies, all columns as they were; one row for each text."""
    found = exact_dedup(docs, index, id_col, text_col, batch)
    gone = scratch.table(found.where("NOT kept").select(F.col("doc_id").alias("__llm_id")), "gone")
    named = found.select("doc_id").where("doc_id IS NOT NULL").groupBy("doc_id").count()
    if found.where("doc_id IS NULL").isEmpty() and named.where("count > 1").isEmpty():
        # ids name rows: texts stay where they are unless the list of copies is long
        out = docs.join(small_side(gone), F.col(id_col).cast("long") == F.col("__llm_id"), "left_anti")
        return write_and_read(out, new_path(docs.sparkSession, "kept"))
    kept = found.where("kept").select(F.col("doc_id").alias("__llm_id"), F.col("text_sha256").alias("__llm_digest")).distinct()
    keyed = docs.withColumn("__llm_sha", digest_of(F.col(text_col)))
    joined = keyed.join(kept, F.col(id_col).cast("long").eqNullSafe(F.col("__llm_id")) & (F.col("__llm_sha") == F.col("__llm_digest")), "left_semi")
    repeats = found.where("kept").groupBy("text_sha256").count().where("count > 1").select(F.col("text_sha256").alias("__llm_twice"))
    once = joined.join(repeats, F.col("__llm_sha") == F.col("__llm_twice"), "left_anti")
    twice = joined.join(repeats, F.col("__llm_sha") == F.col("__llm_twice"), "left_semi").dropDuplicates(["__llm_sha"])
    return write_and_read(once.unionByName(twice).drop("__llm_sha"), new_path(docs.sparkSession, "kept"))
