"""Exact duplicates against a persistent digest index.

The index is a table of one row per distinct text, bucketed and sorted by digest.
A new batch is reduced to its distinct digests, anti-joined to the index by
sort-merge (the index side is already dealt out and sorted, so only the batch
moves) and what is new is appended.  Running a batch twice appends nothing.

Defined cases: a null text is the empty text, so null and empty texts are one
group; a null doc_id sorts last and stays only if all its group have none; rows
that repeat a doc_id and its text count in ``group_size`` and are one document, of
which :func:`deduplicate` keeps one row; ``group_size`` and ``keep_id`` are those of the
first batch that had the text, and later batches leave them as they are; an empty table gives no rows; other
columns, whatever their names, are carried by :func:`deduplicate`.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelf.llm.common import SPACE, Workspace, partitions, text_of

#: A text with more than this share of a batch is looked up by broadcast, so that
#: its rows need not meet in one task.  There are at most 1/share such texts.
HOT_SHARE = 1e-3


def digest(text: Column) -> Column:
    """SHA-256 of a text with each run of white space made one blank."""
    return F.unhex(F.sha2(F.regexp_replace(text, SPACE, " ").cast("binary"), 256))


class DigestIndex:
    """A table (digest, keep_id, group_size) bucketed and sorted by digest."""

    def __init__(self, spark: SparkSession, name: str, location: str, buckets: int):
        self.spark, self.name = spark, name
        spark.sql(
            f"CREATE TABLE IF NOT EXISTS {name} (digest BINARY, keep_id BIGINT, group_size BIGINT) USING parquet"
            f" CLUSTERED BY (digest) SORTED BY (digest) INTO {buckets} BUCKETS LOCATION '{location}'"
        )

    def rows(self) -> DataFrame:
        return self.spark.table(self.name)

    def add(self, digests: DataFrame) -> None:
        """Append what ``digests`` (doc_id, digest) has and the index has not.  The
        batch is written first: else the join would be moved below its aggregate, and
        all copies of a text would be dealt to one task."""
        batch = Workspace(self.spark, "batch").write(digests.groupBy("digest").agg(
            F.min("doc_id").cast("long").alias("keep_id"), F.count(F.lit(1)).alias("group_size")), "batch")
        fresh = batch.join(self.rows().select("digest").hint("merge"), "digest", "left_anti")
        fresh.select("digest", "keep_id", "group_size").write.insertInto(self.name)


def hot_rows(digests: DataFrame, rows: DataFrame) -> DataFrame:
    """The rows of the index for texts that are frequent in this batch, whatever their
    size in the index: at most 1/HOT_SHARE."""
    most = max(1.0, digests.count() * HOT_SHARE)
    often = digests.groupBy("digest").count().where(F.col("count") > most).select("digest")
    return rows.join(F.broadcast(often), "digest", "left_semi")


def look_up(digests: DataFrame, index: DigestIndex) -> DataFrame:
    """Each document with the row of its text in the index."""
    rows = index.rows()
    hot = hot_rows(digests, rows)
    common = digests.join(F.broadcast(hot.select("digest", F.col("keep_id").alias("hot_id"), F.col("group_size").alias("hot_size"))), "digest", "left")
    found = common.where(F.col("hot_size").isNotNull()).select(
        "doc_id", "digest", F.col("hot_id").alias("keep_id"), F.col("hot_size").alias("group_size"))
    rest = common.where(F.col("hot_size").isNull()).select("doc_id", "digest").join(rows.hint("merge"), "digest")
    return found.unionByName(rest.select("doc_id", "digest", "keep_id", "group_size")).withColumn(
        "kept", F.col("doc_id").eqNullSafe(F.col("keep_id")))


def exact_groups(docs: DataFrame, buckets: int | None = None, index: DigestIndex | None = None) -> DataFrame:
    """One row per document: doc_id, digest, keep_id, group_size, kept.

    Without ``index`` the documents are the first batch of a new one.
    """
    spark = docs.sparkSession
    work = Workspace(spark, "exact")
    digests = work.write(docs.select("doc_id", digest(text_of()).alias("digest")), "digests")
    own = index or DigestIndex(spark, f"digests_{uuid.uuid4().hex}", work.path("index"), buckets or partitions(spark))
    own.add(digests)
    found = look_up(digests, own)
    if index is None:  # the name goes; the files are read by what was returned
        spark.sql(f"DROP TABLE {own.name}")
    return found


def deduplicate(docs: DataFrame, buckets: int | None = None) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns."""
    groups = Workspace(docs.sparkSession, "exact-kept").write(exact_groups(docs, buckets), "groups")
    gone = groups.where("NOT kept").select(F.col("doc_id").alias("gone_id"), F.col("digest").alias("gone_digest"))
    again = groups.where("kept").groupBy("doc_id", "digest").count().where("count > 1").select(
        F.col("doc_id").alias("gone_id"), F.col("digest").alias("gone_digest"))
    keyed = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), digest(text_of()).alias("own_digest"))
    same = F.col("row.doc_id").eqNullSafe(F.col("gone_id")) & (F.col("own_digest") == F.col("gone_digest"))
    plain = keyed.join(gone.unionByName(again), same, "left_anti")
    if again.isEmpty():
        return plain.select("row.*")
    # rows that repeat both id and text: any one of them
    repeated = keyed.join(again, same, "left_semi").groupBy("row.doc_id", "own_digest").agg(F.first("row").alias("row"))
    return plain.select("row.*").unionByName(repeated.select("row.*"))
