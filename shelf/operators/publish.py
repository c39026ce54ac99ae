"""The published data set: projection, order, statistics, buckets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelf import vocabulary as V
from shelf.functions.roast import roast_bucket
from shelf.functions.text import blank, filled, strip_html
from shelf.operators.diff import flag_new, publish_key

PUBLISHED = [
    "roaster", "bean_name", "url", "roast_profile", "origin", "price_aud", "process", "varietal",
    "flavour_profile", "is_new",
]


def published_time(raw: Column) -> Column:
    """'2026-02-27_200110' as '2026-02-27 20:01'; anything else as it is."""
    parsed = F.try_to_timestamp(raw, F.lit("yyyy-MM-dd_HHmmss"))
    return F.coalesce(F.date_format(parsed, "yyyy-MM-dd HH:mm"), raw)


def without_shops(items: DataFrame, shops=tuple(V.UNPUBLISHED_SHOPS)) -> DataFrame:
    return items.where(~F.lower(F.trim(blank(F.col("roaster")))).isin(list(shops)))


def published_items(latest: DataFrame, previous: DataFrame,
                    hidden_shops=tuple(V.UNPUBLISHED_SHOPS)) -> DataFrame:
    """Rows to publish with the new-arrival flag, not yet sorted.

    Keys of the previous snapshot come from all its rows, error rows too.
    """
    keys = publish_key()
    shown = latest.where(~F.col("status").eqNullSafe("error"))
    shown = without_shops(shown, hidden_shops).withColumns(keys)
    flagged = flag_new(shown, previous.withColumns(keys), list(keys))
    plain = {c: strip_html(F.col(c)) for c in
             ("roaster", "bean_name", "origin", "process", "varietal", "flavour_profile")}
    return flagged.withColumns(plain).withColumn(
        "url", blank(F.coalesce(filled(F.col("source_url")), F.col("product_url"))))


def in_publish_order(items: DataFrame) -> DataFrame:
    """New first, then shop and bean in code-point order, then the order of arrival."""
    return items.orderBy(F.desc("is_new"), "roaster", "bean_name", "ord").select(*PUBLISHED)


def publish_stats(items: DataFrame) -> DataFrame:
    """One row: items, new items, shops with a name."""
    return items.agg(
        F.count("*").alias("total"),
        F.count_if("is_new").alias("new"),
        F.count_distinct(filled(F.col("roaster"))).alias("roasters"),
    )


def published_shops(items: DataFrame) -> DataFrame:
    return items.select("roaster").where("roaster <> ''").distinct().orderBy("roaster")


def snapshot_summary(items: DataFrame, by: list[str] | None = None) -> DataFrame:
    return items.groupBy(*(by or [])).agg(
        F.count("*").alias("total_rows"),
        F.count_if(F.col("status") == "ok").alias("ok_rows"),
        F.count_if(F.col("status") == "error").alias("error_rows"),
    )


def with_bucket(items: DataFrame) -> DataFrame:
    """Roast bucket of every row; error rows and unseen profiles are 'unknown'."""
    return items.withColumn("bucket", roast_bucket(F.col("roast_profile")))
