"""Extraction quality of snapshots and between two of them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelf import vocabulary as V
from shelf.functions.text import blank, filled
from shelf.operators.select import last_per_key, top_per_group


def good_items(items: DataFrame) -> DataFrame:
    """The rows that quality is measured on: those without an error."""
    return items.where("status = 'ok'")


def is_empty(c: Column) -> Column:
    return F.trim(blank(c)) == ""


def completeness(items: DataFrame, fields: Sequence[str] = tuple(V.QUALITY_FIELDS)) -> DataFrame:
    """One row per field: blank values of how many rows.  One pass, then unpivoted."""
    counts = items.agg(
        F.count("*").alias("n_rows"),
        *[F.count_if(is_empty(F.col(f))).alias(f) for f in fields],
    )
    pairs = ", ".join(f"'{f}', `{f}`" for f in fields)
    return counts.selectExpr(f"stack({len(fields)}, {pairs}) AS (field, n_empty)", "n_rows")


def is_contaminated(c: Column, contaminants=tuple(V.CONTAMINANTS)) -> Column:
    return F.lower(blank(c)).rlike("|".join(contaminants))


def contamination(items: DataFrame, column: str = "process",
                  contaminants=tuple(V.CONTAMINANTS)) -> DataFrame:
    return items.agg(
        F.count_if(is_contaminated(F.col(column), contaminants)).alias("n_contaminated"),
        F.count("*").alias("n_rows"),
    )


def newly_filled(before: DataFrame, after: DataFrame, keys: Sequence[str], order: str,
                 fields: Sequence[str] = tuple(V.QUALITY_FIELDS)) -> DataFrame:
    """Per field: rows blank before and filled after, over keys on both sides.

    Of rows with the same key the last one counts, on either side.
    """
    def flags(df: DataFrame, prefix: str) -> DataFrame:
        slim = df.select(*keys, order, *[is_empty(F.col(f)).alias(prefix + f) for f in fields])
        return last_per_key(slim, keys, F.col(order)).drop(order)

    both = flags(after, "a_").join(flags(before, "b_"), list(keys))
    counts = both.agg(*[
        F.count_if(F.col(f"b_{f}") & ~F.col(f"a_{f}")).alias(f) for f in fields])
    pairs = ", ".join(f"'{f}', `{f}`" for f in fields)
    return counts.selectExpr(f"stack({len(fields)}, {pairs}) AS (field, n_filled)")


def health_alert(items: DataFrame, threshold: int = V.ALERT_SHOPS) -> DataFrame:
    """Shops with an error row, and whether they are enough to raise an alert."""
    failing = F.count_distinct(F.when(F.col("status") == "error", filled(F.col("roaster"))))
    return items.agg(failing.alias("failing_shops")).withColumn(
        "alert", F.col("failing_shops") >= threshold)


def joined_errors(errors: DataFrame, keys: Sequence[str], order: str, message: str,
                  count: int | None = None, separator: str = "; ") -> DataFrame:
    """Messages per key in order, joined; with ``count`` only the first ones, and the
    rest never leaves its task."""
    few = errors if count is None else top_per_group(errors, keys, [F.col(order)], count)
    listed = F.array_sort(F.collect_list(F.struct(order, message)))
    return few.groupBy(*keys).agg(
        F.array_join(F.transform(listed, lambda e: e[message]), separator).alias("errors"))
