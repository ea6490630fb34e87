"""Exact dedup against a persistent digest index.

The index is a table of ``(digest, keep_id)``, bucketed and sorted by digest, that lives in
a folder and outlasts the session. A batch of documents is reduced to one row per digest,
anti-joined with the index (both sides come bucketed by digest, so the index is never
shuffled) and what is new is appended; then every document finds the row that stays.

Defined cases: a null text counts as empty; rows without a doc_id can be dropped but stay
only where no equal text has one; of rows equal in doc_id and text exactly one stays; an
empty table gives no rows; other columns are ignored. A batch that is run again finds all
its digests in the index and gives the same result, as long as earlier batches held no equal text
(then the earlier row stays).
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiprop.llm.common import SPACE_RUN, column, join_groups, row_hash, shared_path, stored

DEFAULT_BUCKETS = 64


def text_digest(text: Column) -> Column:
    """Lowercase hex SHA-256 of the text with each run of white space made one space."""
    return F.sha2(F.regexp_replace(F.coalesce(text, F.lit("")), SPACE_RUN, " "), 256)


class DigestIndex:
    """A bucketed, sorted Parquet table of digests at ``path``.

    ``buckets`` is fixed when the folder is first written and must be the same whenever it is
    opened again; size it so that a bucket of the final index fits an executor.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int = DEFAULT_BUCKETS):
        self.spark, self.path, self.buckets = spark, path, buckets
        self.table = f"digest_index_{uuid.uuid4().hex}"
        spark.sql(
            f"CREATE TABLE {self.table} (digest STRING, keep_id BIGINT) USING parquet "
            f"CLUSTERED BY (digest) SORTED BY (digest) INTO {buckets} BUCKETS LOCATION '{path}'"
        )

    def read(self) -> DataFrame:
        return self.spark.table(self.table)

    def append(self, entries: DataFrame) -> None:
        """Adds ``(digest, keep_id)`` rows: one sorted file per bucket."""
        rows = entries.select("digest", F.col("keep_id").cast("long"))
        rows.repartition(self.buckets, "digest").write.insertInto(self.table)
        self.spark.catalog.refreshTable(self.table)

    def anti_join(self, groups: DataFrame) -> DataFrame:
        """The groups whose digest the index lacks (sort-merge anti-join)."""
        return groups.join(self.read().hint("merge"), "digest", "left_anti")


def dedup_batch(docs: DataFrame, index: DigestIndex) -> DataFrame:
    """``(doc_id, keep_id, group_size, kept, text_sha256)`` for every row of ``docs``; appends
    the batch's new digests to ``index``.

    ``group_size`` counts the equal texts of the batch. ``keep_id`` is the row that stays:
    that of the index where an earlier batch had the text, else the smallest doc_id.
    """
    rows = docs.select(
        column(docs, "doc_id", "long").alias("doc_id"),
        text_digest(column(docs, "text", "string")).alias("digest"),
        F.monotonically_increasing_id().alias("row"),  # tells apart rows equal in doc_id and text
    )
    rows = stored(rows, "digests")
    smallest = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row"))
    groups = rows.groupBy("digest").agg(smallest.alias("first"), F.count(F.lit(1)).alias("group_size"))
    groups = stored(groups.select("digest", F.col("first.doc_id").alias("first_id"), F.col("first.row").alias("first_row"), "group_size"), "digest-groups")
    new = index.anti_join(groups).select("digest", F.col("first_id").alias("keep_id"))
    index.append(stored(new, "digests-new"))  # stored first: a table can't be read and added to in one job
    entries = index.read().hint("merge").join(groups.select("digest", "group_size", "first_row"), "digest")
    out = join_groups(rows, entries, "digest", "group_size", rows.count())
    stays = F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("row") == F.col("first_row"))
    return out.select(
        "doc_id", "keep_id", F.col("group_size").cast("long").alias("group_size"), stays.alias("kept"), F.col("digest").alias("text_sha256")
    )


def new_index(spark: SparkSession, buckets: int = DEFAULT_BUCKETS) -> DigestIndex:
    """An empty index in the shared folder."""
    return DigestIndex(spark, shared_path(spark, "digest-index"), buckets)


def kept_documents(docs: DataFrame, index: DigestIndex) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns, whatever their names.

    Texts are joined once with a narrow table of what stays. Of rows equal in doc_id and text the one with
    the smallest hash of all columns stays.
    """
    same = dedup_batch(docs, index).groupBy("doc_id", F.col("text_sha256").alias("digest"))
    stays = same.agg(F.max("kept").alias("kept"), F.count(F.lit(1)).alias("members")).filter("kept")
    name = lambda digest, doc_id: F.concat(digest, F.lit(":"), F.coalesce(doc_id.cast("string"), F.lit("")))
    key = name(text_digest(column(docs, "text", "string")), column(docs, "doc_id", "long"))
    rows = docs.select(key.alias("key"), row_hash(docs).alias("hash"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    found = rows.join(stays.select(name(F.col("digest"), F.col("doc_id")).alias("key"), "members"), "key")
    several = found.filter("members > 1").groupBy("key").agg(F.min_by("row", "hash").alias("row"))
    return found.filter("members = 1").select("row").unionByName(several.select("row")).select("row.*")
