"""What is new against the snapshot before."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelf.functions.text import clean_text, filled, key_text


def publish_key(roaster: str = "roaster", bean: str = "bean_name") -> dict[str, Column]:
    """Identity at publish: normalised roaster and bean."""
    return {"key_roaster": key_text(F.col(roaster)), "key_bean": key_text(F.col(bean))}


def item_identity() -> Column:
    """Identity at collection: the address, else 'roaster::bean'."""
    address = clean_text(F.coalesce(filled(F.col("source_url")), F.col("product_url")))
    named = F.concat(clean_text(F.col("roaster")), F.lit("::"), clean_text(F.col("bean_name")))
    return F.coalesce(filled(address), named)


def flag_new(current: DataFrame, previous: DataFrame, keys: Sequence[str],
             flag: str = "is_new") -> DataFrame:
    """Add a flag to every current row; duplicates share it."""
    seen = previous.select(*keys).distinct().withColumn("_seen", F.lit(True))
    return current.join(seen, list(keys), "left").withColumn(
        flag, F.col("_seen").isNull()).drop("_seen")


def flag_new_rows(current: DataFrame, previous: DataFrame) -> DataFrame:
    """Rows with ``is_new``: without an error, and of an identity not seen before."""
    named = current.withColumn("_identity", item_identity())
    seen = previous.select(item_identity().alias("_identity"))
    flagged = flag_new(named, seen, ["_identity"]).drop("_identity")
    return flagged.withColumn("is_new", F.col("is_new") & (F.col("status") == "ok"))


def new_keys(current: DataFrame, previous: DataFrame, key: str) -> DataFrame:
    """Set difference of identities."""
    return current.select(key).distinct().join(previous.select(key), key, "left_anti")


def arrivals_by_snapshot(rows: DataFrame, keys: Sequence[str], by: str) -> DataFrame:
    """Every (snapshot, key) with a flag: was it missing one snapshot earlier?

    A key that leaves and returns is new again.  Snapshots are numbered from
    their own short list, the only rows that meet in one task; a key then needs only its own earlier appearance.
    """
    seen = rows.select(by, *keys).distinct()
    numbered = seen.select(by).distinct().select(
        by, F.dense_rank().over(Window.orderBy(by)).alias("_seq"))
    before = F.lag("_seq").over(Window.partitionBy(*keys).orderBy("_seq"))
    return seen.join(numbered, by).withColumn("_before", before).select(
        by, *keys, (~F.col("_before").eqNullSafe(F.col("_seq") - 1)).alias("is_new"))
