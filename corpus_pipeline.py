"""A corpus made ready for training: five stages over ``documents``, in this order.

Toxic documents go; of equal texts one stays; of each group of near copies one stays;
documents that hold benchmark items go; what is left is packed into sequences.  All
stages but the last return the columns of ``documents``; a stage sees what the one
before it kept, written as Parquet and read again, and the tables a stage needed are
removed when the next one begins.

Null and empty texts, repeated rows, empty tables and further columns are handled as
the operators' modules say; a row is kept with all its columns.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from shelf.llm import exact, minhash, packing, tiling, toxic
from shelf.llm.common import Workspace, fold, table

#: SQL has no kernel machine, registers or tiling; the stages are tested one by one.
ORACLE_SQL = None


#: Workspaces of the stage that ran last.  What it returned is written when the next stage
#: begins, as that reads it, so they go then.
_last: list[Workspace] = []


def _stage(function: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    @functools.wraps(function)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        while _last:
            _last.pop().drop()
        before = len(Workspace.made)
        out = function(spark, docs, sf_dir)
        _last.extend(Workspace.made[before:])
        return out

    return run_stage


@_stage
def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the machine does not reject; it learns from the labelled
    documents outside the held-out fold."""
    model = toxic.fit(toxic.labelled(docs.where(fold(docs, 4) != 2), table(spark, sf_dir, "labels")))
    return toxic.accepted(docs, model)


@_stage
def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with one text, but for white space, the first by id."""
    return exact.deduplicate(docs)


@_stage
def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the first by id."""
    return minhash.deduplicate(docs, limit=0.8)


@_stage
def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    return tiling.decontaminate(docs, table(spark, sf_dir, "benchmark"))


@_stage
def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document stands in the training sequences."""
    return packing.pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_copies),
    ("near_dedup", drop_near_copies),
    ("decontamination", drop_leaks),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    work = Workspace(spark, "pipeline")
    for number, (name, stage) in enumerate(STAGES):
        docs = work.write(stage(spark, docs, sf_dir), f"{number}-{name}")
    return docs
