"""Choosing rows: newest snapshots, first or last per key, best source, top k."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def newest(df: DataFrame, by: str, count: int = 2, names: Sequence[str] | None = None) -> DataFrame:
    """Rows of the newest ``count`` snapshots, with ``age`` 1 for the newest.

    The ``count`` names are looked up first and then filtered on as literals, so
    a table partitioned by ``by`` is pruned before anything is read, and no join
    is needed.  ``names``, where all of them are known, as from the folders of a
    table (``statistics.partition_names``), saves the look-up.
    """
    if names is not None:
        names = sorted(names, reverse=True)[:count]
    else:
        names = [r[0] for r in df.select(by).distinct().orderBy(F.desc(by)).limit(count).collect()]
    age = F.lit(None).cast("int")
    for place, name in reversed(list(enumerate(names, 1))):
        age = F.when(F.col(by) == F.lit(name), F.lit(place)).otherwise(age)
    return df.where(F.col(by).isin(names)).withColumn("age", age)


def expired(df: DataFrame, by: str, keep: int = 2) -> DataFrame:
    """The snapshots that retention drops."""
    names = df.select(by).distinct()
    kept = names.orderBy(F.desc(by)).limit(keep)
    return names.join(F.broadcast(kept), by, "left_anti")


def _one_per_key(df: DataFrame, keys: Sequence[str], order: Column, pick) -> DataFrame:
    rest = [c for c in df.columns if c not in keys]
    chosen = df.groupBy(*keys).agg(pick(F.struct(*rest), order).alias("_row"))
    return chosen.select(*keys, *[F.col("_row")[c].alias(c) for c in rest])


def first_per_key(df: DataFrame, keys: Sequence[str], order: Column) -> DataFrame:
    """First seen wins.  An aggregate, so every task reduces its rows before the shuffle."""
    return _one_per_key(df, keys, order, F.min_by)


def last_per_key(df: DataFrame, keys: Sequence[str], order: Column) -> DataFrame:
    return _one_per_key(df, keys, order, F.max_by)


def top_per_group(df: DataFrame, keys: Sequence[str], order: Sequence[Column], count: int,
                  rank: str = "rank") -> DataFrame:
    """First ``count`` rows per group.  Spark limits each group within every task
    before the shuffle, so a group of any size moves few rows."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn(rank, place).where(F.col(rank) <= count)


def pick_source(rows: DataFrame, keys: Sequence[str], priority: str) -> DataFrame:
    """Cascade: per key all rows of the first source that has any.

    The winners come from a count-sized table, so rows are not windowed.
    """
    best = rows.groupBy(*keys).agg(F.min(priority).alias(priority))
    return rows.join(best, [*keys, priority])


def best_of(rows: DataFrame, keys: Sequence[str], candidate: str, order: str) -> DataFrame:
    """Per key the candidate with most rows; the earlier one on ties."""
    sizes = rows.groupBy(*keys, candidate).agg(
        F.count("*").alias("_n"), F.min(order).alias("_order"))
    best = sizes.groupBy(*keys).agg(
        F.max_by(F.struct(candidate, "_n"), F.struct(F.col("_n"), -F.col("_order"))).alias("_best"))
    best = best.select(
        *keys, F.col("_best")[candidate].alias(candidate), F.col("_best")["_n"].alias("n_rows"))
    return rows.join(best, [*keys, candidate])
