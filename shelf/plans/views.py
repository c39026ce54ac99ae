"""Catalogue-shaped views over the sample tables, and the same views as SQL.

An offer is a part that ships in a month: the month is the snapshot, the brand
the shop.  The same bean is spelled differently in even and odd months, so keys
only agree after normalisation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelf.operators.select import newest
from shelf.plans.registry import table
from shelf.session import written
from shelf.sources.statistics import newest_periods

ROAST_OF_TYPE = {
    "ECONOMY": "filter", "SMALL": "espresso", "PROMO": "omni", "STANDARD": "Filter",
    "LARGE": "espresso",
}
HIDDEN_SHOP = "brand#7"
SITE = "https://shop.example.com"


def shipped(spark: SparkSession, sf_dir: str, since: Column | None = None) -> DataFrame:
    """(snapshot, p_partkey), repeated as often as shipped, all or since a date."""
    lines = table(spark, sf_dir, "lineitem")
    if since is not None:
        lines = lines.where(F.col("l_shipdate") >= since)
    return lines.select(
        F.date_format("l_shipdate", "yyyy-MM").alias("snapshot"), F.col("l_partkey").alias("p_partkey"))


def as_offers(shipments: DataFrame, parts: DataFrame) -> DataFrame:
    """Distinct shipments as catalogue items."""
    rows = shipments.distinct().join(parts, "p_partkey")
    even = F.substring("snapshot", 6, 2).cast("int") % 2 == 0
    bean = F.when(even, F.concat("p_name", F.lit(" – "), "p_type")).otherwise(
        F.concat(F.upper("p_name"), F.lit(" &#45;  "), "p_type"))
    roast = F.coalesce(
        F.create_map(*[F.lit(x) for kv in ROAST_OF_TYPE.items() for x in kv])[F.col("p_type")], F.lit(""))
    address = F.when(F.col("p_size") % 10 == 0, F.lit("")).otherwise(
        F.concat(F.lit(SITE + "/products/"), F.col("p_partkey").cast("string")))
    return rows.select(
        *[c for c in shipments.columns if c != "p_partkey"], F.col("p_partkey").alias("ord"),
        F.col("p_brand").alias("roaster"), address.alias("source_url"), bean.alias("bean_name"),
        roast.alias("roast_profile"), F.lit("").alias("origin"),
        F.col("p_retailprice").cast("decimal(10,2)").cast("string").alias("price_aud"),
        F.lit("").alias("process"), F.concat(F.lit("<i>"), "p_type", F.lit("</i>")).alias("varietal"),
        F.col("p_name").alias("flavour_profile"), address.alias("product_url"),
        F.when(F.col("p_size") == 50, "error").otherwise("ok").alias("status"),
        F.when(F.col("p_size") == 50, "missing_product_title").otherwise("").alias("error"))


def offers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_offers(shipped(spark, sf_dir), table(spark, sf_dir, "part"))


def newest_offers(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The newest snapshot and the one before.  Two dates are looked up in the files'
    statistics; the rows since the earlier one are a range on the raw date, which is pushed
    to the scan."""
    since = min(newest_periods(table(spark, sf_dir, "lineitem"), "l_shipdate"), default=None)
    recent = shipped(spark, sf_dir, F.lit(None if since is None else since.isoformat(sep=" ")).cast("timestamp_ntz"))
    # both ages are read, and more than once
    rows = written(as_offers(newest(recent, "snapshot", 2), table(spark, sf_dir, "part")), "offers")
    return rows.where("age = 1"), rows.where("age = 2")


OFFERS = """
shipped AS (SELECT DISTINCT strftime(l_shipdate, '%Y-%m') AS snapshot, l_partkey AS p_partkey FROM lineitem),
offers AS (
  SELECT s.snapshot, p.p_partkey AS ord, p.p_brand AS roaster, p.p_name, p.p_type,
         CASE WHEN p.p_size % 10 = 0 THEN '' ELSE 'https://shop.example.com/products/' || p.p_partkey END AS url,
         CASE WHEN CAST(substr(s.snapshot, 6, 2) AS INT) % 2 = 0 THEN p.p_name || ' – ' || p.p_type
              ELSE upper(p.p_name) || ' &#45; ' || p.p_type END AS bean_name,
         CASE p.p_type WHEN 'ECONOMY' THEN 'filter' WHEN 'SMALL' THEN 'espresso' WHEN 'PROMO' THEN 'omni'
              WHEN 'STANDARD' THEN 'Filter' WHEN 'LARGE' THEN 'espresso' ELSE '' END AS roast_profile,
         CAST(CAST(p.p_retailprice AS DECIMAL(10, 2)) AS VARCHAR) AS price_aud,
         CASE WHEN p.p_size = 50 THEN 'error' ELSE 'ok' END AS status
  FROM shipped s JOIN part p USING (p_partkey)),
ages AS (
  SELECT snapshot, row_number() OVER (ORDER BY snapshot DESC) AS age
  FROM (SELECT DISTINCT snapshot FROM offers)),
keyed AS (
  SELECT o.*, a.age, roaster || '|' || lower(p_name) || '|' || lower(p_type) AS key
  FROM offers o JOIN ages a USING (snapshot))
"""
