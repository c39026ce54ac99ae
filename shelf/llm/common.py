"""Helpers shared by the operators of this package."""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from shelf.session import delete, new_folder

#: White space of the contracts: blank and the ASCII controls from tab to carriage return.
SPACE = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(name: str = "text") -> Column:
    """A text, with null read as the empty string."""
    return F.coalesce(F.col(name), F.lit(""))


def fold(df: DataFrame, modulus: int) -> Column:
    """Which of ``modulus`` folds a document is in: crc32 of its id as text.
    A null id is in fold 0."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % modulus, F.lit(0))


def per_worker(key: tuple, make: Callable[[], Any]) -> Any:
    """What ``make`` gives, made once in each Python process.  Functions come to a
    worker by value with every task, so their own globals would not last."""
    kept = sys.__dict__.setdefault("_shelf_llm_kept", {})
    if key not in kept:
        kept[key] = make()
    return kept[key]


class Workspace:
    """Tables that one run writes under the shared folder, so that what follows
    neither recomputes them nor depends on an executor that may be lost."""

    #: All that this process has made, in order.
    made: list[Workspace] = []

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.folder = new_folder(spark, name)
        Workspace.made.append(self)

    def path(self, name: str) -> str:
        return f"{self.folder}/{name}"

    def write(self, df: DataFrame, name: str) -> DataFrame:
        path = self.path(name)
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, name: str = "") -> None:
        """Remove one table, or all of them, once nothing reads them."""
        delete(self.spark, self.path(name) if name else self.folder)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def map_texts(docs: DataFrame, keep: tuple[str, ...], fields: str, make: Callable[[], Callable], rows: int = 256) -> DataFrame:
    """The columns ``keep`` with new ones computed from the texts (null: empty).

    ``make`` is called once in a task and gives a function from a list of texts to a
    list of columns, which sees at most ``rows`` texts at a time.  Kept columns pass
    through as they are, nulls and types included."""
    source = docs.select(F.col("text").alias("own text"), *keep)
    out = T.StructType(source.schema.fields[1:] + T.StructType.fromDDL(fields).fields)
    arrow = to_arrow_schema(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compute = make()
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                part = batch.slice(at, rows)
                new = compute([t or "" for t in part.column(0).to_pylist()])
                kept = part.columns[1:]
                types = [f.type for f in arrow][len(kept):]
                yield pa.RecordBatch.from_arrays(
                    [*kept, *[pa.array(c, type=t) for c, t in zip(new, types, strict=True)]], names=out.names)

    return source.mapInArrow(run, out)


def filter_texts(docs: DataFrame, make: Callable[[], Callable], rows: int = 256) -> DataFrame:
    """The rows whose text (null: empty) passes, with all their columns.  ``make`` as
    above; its function gives a list of booleans."""
    at_text = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        passes = make()
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                part = batch.slice(at, rows)
                yield part.filter(pa.array(passes([t or "" for t in part.column(at_text).to_pylist()]), type=pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
