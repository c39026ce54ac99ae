"""Writing snapshots, the published data set and spreadsheets' CSV."""

from __future__ import annotations

import json
import sys

import pyarrow as pa
import pyarrow.fs
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelf.functions.text import clean_text
from shelf.operators.publish import (
    in_publish_order, publish_stats, published_shops, snapshot_summary, with_bucket,
)
from shelf.schemas import ITEM_COLUMNS
from shelf.session import dropped, written

cloudpickle.register_pickle_by_value(sys.modules[__name__])

CSV_COLUMNS = [
    "roaster", "bean_name", "roast_profile", "origin", "price_aud", "process", "varietal",
    "flavour_profile", "status", "error",
]


def write_snapshot(items: DataFrame, folder: str, snapshot: str = "snapshot") -> None:
    """Items by snapshot and roast bucket, plus a summary row per snapshot.

    Buckets are folders rather than arrays in one document: one bucket can hold
    most of a snapshot.  Rebalancing gives every folder few files and splits a
    folder that is too large for one task.  The input is computed once.  Writing a
    snapshot again replaces its folders, so a repeated run changes nothing.
    """
    items = written(items, "items")

    def write(df, name, *by):
        df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(f"{folder}/{name}")

    write(with_bucket(items).hint("rebalance", snapshot, "bucket"), "items", snapshot, "bucket")
    write(snapshot_summary(items, [snapshot]), "summary", snapshot)
    dropped(items)


def write_published(items: DataFrame, generated_at: Column, folder: str) -> None:
    """Sorted items, one row of statistics and the list of shops."""
    items = written(items, "items")
    in_publish_order(items).write.mode("overwrite").json(f"{folder}/items")
    publish_stats(items).withColumn("generated_at", generated_at).write.mode("overwrite").json(
        f"{folder}/stats")
    published_shops(items).write.mode("overwrite").json(f"{folder}/roasters")
    dropped(items)


def hyperlink(url: Column, label: Column) -> Column:
    """A spreadsheet link formula; '' without an address, 'buy' without a label."""
    text = F.coalesce(F.nullif(clean_text(label), F.lit("")), F.lit("buy"))
    formula = F.concat(
        F.lit('=HYPERLINK("'), clean_text(url), F.lit('","'),
        F.replace(text, F.lit('"'), F.lit('""')), F.lit('")'))
    return F.when(clean_text(url) == "", F.lit("")).otherwise(formula)


def csv_rows(items: DataFrame) -> DataFrame:
    return items.withColumn("bean_name", hyperlink(F.col("source_url"), F.col("bean_name"))).select(
        *CSV_COLUMNS)


def write_csv(items: DataFrame, folder: str) -> None:
    csv_rows(items).write.mode("overwrite").option("header", True).option("escape", '"').option(
        "emptyValue", "").csv(folder)


def read_csv(spark, folder: str) -> DataFrame:
    """CSV rows back; an empty cell is the empty string."""
    schema = ", ".join(f"{c} STRING" for c in CSV_COLUMNS)
    rows = spark.read.schema(schema).option("header", True).option("escape", '"').csv(folder)
    return rows.na.fill("")


def write_documents(items: DataFrame, folder: str, snapshot: str = "snapshot", order: str = "ord") -> DataFrame:
    """Snapshots as one JSON document each, ``list_<snapshot>.json``: (file, items).

    A document cannot be cut, so one task writes it, but row by row: nothing of it is
    held but the row.  Files of repeated tasks replace each other.
    """
    texts = items.select(
        F.col(snapshot).alias("_name"), F.col(order).alias("_ord"),
        F.to_json(F.struct(*ITEM_COLUMNS), {"ignoreNullFields": "false"}).alias("_item"))

    def write(batches):
        name, out, number = None, None, 0
        fs, root = pyarrow.fs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (
            pyarrow.fs.LocalFileSystem(), folder)
        fs.create_dir(root, recursive=True)

        def close():
            out.write(b"\n]}\n")
            out.close()
            return pa.RecordBatch.from_pydict({"file": [f"list_{name}.json"], "items": pa.array([number], pa.int64())})

        for batch in batches:
            for own, item in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
                if own != name or out is None:
                    if out is not None:
                        yield close()
                    name, number = own, 0
                    out = fs.open_output_stream(f"{root}/list_{own}.json")
                    out.write(b'{"generated_at": ' + json.dumps(own).encode() + b', "items": [\n')
                out.write((b",\n" if number else b"") + item.encode())
                number += 1
        if out is not None:
            yield close()

    # the rows of the result are the files, so it is written to run the tasks once
    return written(texts.repartition("_name").sortWithinPartitions("_name", "_ord").mapInArrow(
        write, "file string, items long"), "documents")
