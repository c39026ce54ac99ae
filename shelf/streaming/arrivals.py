"""New arrivals as snapshots come in."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelf.operators.diff import arrivals_by_snapshot
from shelf.operators.select import newest
from shelf.streaming.base import run_available


def follow_arrivals(stream: DataFrame, folder: str, keys: Sequence[str], by: str) -> None:
    """Flag what is new in the waiting snapshots and write it to ``arrivals``.

    A batch is compared with the keys of the two newest snapshots before it, kept
    in ``state``; nothing older is read again.  Each batch overwrites its own
    folders, so a repeated batch changes nothing.  Snapshots have to land in order;
    one that is split over batches is fine.
    """
    spark = stream.sparkSession
    columns = [by, *keys]

    def on_batch(batch: DataFrame, number: int) -> None:
        fresh = batch.select(*columns).distinct()
        if number > 0:
            known = spark.read.schema(fresh.schema).parquet(f"{folder}/state/batch={number - 1}")
            fresh = fresh.join(known, columns, "left_anti")
        # all that follows reads them again
        path = f"{folder}/fresh/batch={number}"
        fresh.write.mode("overwrite").parquet(path)
        fresh = spark.read.schema(fresh.schema).parquet(path)
        both = known.unionByName(fresh) if number > 0 else fresh
        flagged = arrivals_by_snapshot(both, keys, by).join(fresh, columns, "left_semi")
        flagged.write.mode("overwrite").parquet(f"{folder}/arrivals/batch={number}")
        newest(both, by, 2).select(*columns).write.mode("overwrite").parquet(
            f"{folder}/state/batch={number}")

    run_available(stream, on_batch, f"{folder}/checkpoint")


def read_arrivals(spark, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/arrivals").withColumn("batch", F.col("batch").cast("int"))
