"""Running a stream over what is new in a landing folder."""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def landing(spark: SparkSession, folder: str, schema, files_per_batch: int | None = None) -> DataFrame:
    """Files of the landing folder and its sub-folders as a stream."""
    reader = spark.readStream.schema(schema).option("recursiveFileLookup", True)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(folder)


@contextmanager
def rocksdb_state(spark: SparkSession):
    """State with a time to live needs the RocksDB store; the setting is put back."""
    before = spark.conf.get(_PROVIDER)
    spark.conf.set(_PROVIDER, _ROCKSDB)
    try:
        yield
    finally:
        spark.conf.set(_PROVIDER, before)


def run_available(stream: DataFrame, on_batch, checkpoint: str, mode: str = "append") -> None:
    """Work off everything that is there, then stop.  Called again later with the
    same checkpoint it reads only what has come since."""
    query = (
        stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).foreachBatch(on_batch).start())
    query.awaitTermination()


def append_batches(folder: str):
    """A batch writer that can be repeated: each batch owns its folder."""
    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/batch={number}")
    return write
