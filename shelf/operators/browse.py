"""Browsing: facets, search, months, look-up."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelf.functions.localised import both_languages, month_key
from shelf.functions.text import blank

ALL = "all"


def diary_search_text(with_region: bool = False) -> Column:
    """Search text of an entry: names, shops, tags and flavour labels in both languages.

    The region is left out by default, as the browse page never searches it.
    """
    parts = [both_languages(F.col("bean_name")), both_languages(F.col("roaster"))]
    if with_region:
        parts.append(both_languages(F.col("details.region")))
    parts.append(F.flatten(F.transform(F.col("tags"), both_languages)))
    parts.append(F.flatten(F.transform(F.col("flavours"), lambda f: both_languages(f.label))))
    return F.lower(F.concat_ws(" ", *parts))


def facet_filter(df: DataFrame, *, roast: str = ALL, month: str = ALL, query: str = "",
                 search: Column | None = None, roaster: str = ALL, new_only: bool = False) -> DataFrame:
    """Rows that pass every facet that is switched on.  Plain predicates, so they
    reach the scan wherever the source can take them."""
    if roast != ALL:
        df = df.where(F.col("roast_profile") == roast)
    if roaster != ALL:
        df = df.where(F.col("roaster") == roaster)
    if new_only:
        df = df.where("is_new")
    if month != ALL:
        df = df.where(F.col("date").startswith(month) if month else blank(F.col("date")) == "")
    query = query.strip().lower()
    if query:
        if search is None:
            raise ValueError("a query needs the column or expression to search in")
        df = df.where(F.contains(search, F.lit(query)))
    return df


def in_diary_order(df: DataFrame) -> DataFrame:
    """Newest first by the text of the date, blank last, then the order of arrival."""
    return df.orderBy(blank(F.col("date")).desc(), "ord")


def months(df: DataFrame) -> DataFrame:
    """Distinct months with entries, newest first; a blank date is no month."""
    month = df.select(month_key(F.col("date")).alias("month")).where("month <> ''")
    return month.distinct().orderBy(F.desc("month"))


def month_groups(df: DataFrame) -> DataFrame:
    """Size, first and last day per month.  The entries stay rows (``in_diary_order``
    puts them in group order), for a month can be as large as the table."""
    return df.groupBy(month_key(F.col("date")).alias("month")).agg(
        F.count("*").alias("n_entries"),
        F.max("date").alias("last_date"), F.min("date").alias("first_date"))


def month_timeline(entries: DataFrame, matches: DataFrame) -> DataFrame:
    """Every month with a live flag; nothing if there are fewer than two months."""
    every = months(entries)
    live = months(matches).withColumn("live", F.lit(True))
    enough = every.agg((F.count("*") >= 2).alias("_enough"))
    return (
        every.join(live, "month", "left")
        .join(F.broadcast(enough), F.col("_enough"))
        .select("month", F.coalesce("live", F.lit(False)).alias("live"))
    )


def by_slug(df: DataFrame, slug: str) -> DataFrame:
    """The first entry of that slug."""
    return df.where(F.col("slug") == slug).orderBy("ord").limit(1)
