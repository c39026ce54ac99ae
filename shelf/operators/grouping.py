"""Products of one title taken together."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelf.functions.text import blank


def title_groups(products: DataFrame, keys: Sequence[str], order: Column, first: Column,
                 in_stock: Column, categories: Column) -> DataFrame:
    """One row per title that has a member in stock (unknown stock counts as in).

    The first member speaks for the group.  Stock and categories are folded into
    flags with partial aggregation, so a title of any size is never collected.
    """
    names = F.transform(categories, lambda c: F.lower(blank(c)))

    def seen(word):
        return F.bool_or(F.coalesce(F.exists(names, lambda n: F.contains(n, F.lit(word))), F.lit(False)))

    groups = products.groupBy(*keys).agg(
        F.min_by(first, order).alias("first"), F.count("*").alias("n_products"),
        F.bool_or(F.coalesce(in_stock, F.lit(True))).alias("in_stock"),
        seen("espresso").alias("espresso_seen"), seen("filter").alias("filter_seen"))
    return groups.where("in_stock").drop("in_stock")
