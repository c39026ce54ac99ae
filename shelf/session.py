"""Session set-up and the shared folder for checkpoints and written tables."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int | str = "*", partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A session for tests and benchmarks on one machine."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("shelf")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .getOrCreate()
    )


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors can reach, as the cluster names it.

    Only a local master may fall back to a folder of this machine.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    return tempfile.mkdtemp(prefix="shelf-")


# folders that this process has named, for ``cleanup``
_FOLDERS: list[str] = []


def new_folder(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared folder; nothing is created there yet."""
    path = os.path.join(shared_folder(spark), f"{name}-{uuid.uuid4().hex}")
    _FOLDERS.append(path)
    return path


def delete(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def cleanup(spark: SparkSession) -> None:
    """Remove the intermediate tables that this process has written.  A run calls this
    when its results are written, for nothing made from them can be read any more."""
    while _FOLDERS:
        delete(spark, _FOLDERS.pop())


def spread(df: DataFrame) -> DataFrame:
    """Deal rows out evenly, one part for every partition of a shuffle or core.  For rows that
    cost much more than they weigh: a reader cuts files by their size, and merges small
    shuffled parts by theirs, so that such rows can end up in a task or two."""
    spark = df.sparkSession
    return df.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism))


def dropped(df: DataFrame) -> None:
    """Remove the folder of a table made by ``written``, once nothing reads it."""
    for folder in {os.path.dirname(f) for f in df.inputFiles()}:
        delete(df.sparkSession, folder)


def written(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and go on from there.

    This cuts lineage and survives lost executors.  Unlike a checkpoint the rows
    are computed once, their size is known to later joins, and what follows reads
    only the columns it needs.
    """
    folder = new_folder(df.sparkSession, name)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)
