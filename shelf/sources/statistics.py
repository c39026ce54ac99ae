"""What file names and file statistics say, without reading rows.

A table that is partitioned by a column has its values in the names of its folders.  Of
any other, a Parquet file's footer has the least and greatest value of each row group;
footers are read by tasks, a few kilobytes a file.
"""

from __future__ import annotations

import datetime
import re
import sys
from collections.abc import Callable, Iterator
from urllib.parse import unquote

import pyarrow as pa
import pyarrow.fs
import pyarrow.parquet
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelf.session import written

cloudpickle.register_pickle_by_value(sys.modules[__name__])


def partition_names(df: DataFrame, by: str) -> list[str] | None:
    """The values of a partition column by the folders of a table as it was read; None
    if its files are not in such folders."""
    found = [re.search(rf"/{re.escape(by)}=([^/]*)/", f) for f in df.inputFiles()]
    if not all(found):
        return None
    return sorted({unquote(m[1]) for m in found} - {"__HIVE_DEFAULT_PARTITION__"})


def _open(path: str):
    path = re.sub(r"^file:/+", "/", path)
    if re.match(r"\w+:/", path):
        return pyarrow.fs.FileSystem.from_uri(path)
    return pyarrow.fs.LocalFileSystem(), unquote(path)


def row_group_bounds(df: DataFrame, column: str) -> DataFrame:
    """(low, high) of a time without zone for each row group of the Parquet files that a
    table was read from; null where a file does not say."""
    files = df.inputFiles()
    listed = df.sparkSession.createDataFrame([(f,) for f in files], "file string").repartition(max(1, min(len(files), 512)))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for file in batch.column(0).to_pylist():
                fs, path = _open(file)
                with fs.open_input_file(path) as opened:
                    footer = pyarrow.parquet.ParquetFile(opened).metadata
                    place = footer.schema.to_arrow_schema().get_field_index(column)
                    for i in range(footer.num_row_groups):
                        found = footer.row_group(i).column(place).statistics
                        # a group of nulls only has no bounds and no value either
                        if found is None or found.null_count != footer.row_group(i).num_rows:
                            rows.append((found.min, found.max) if found is not None and found.has_min_max else (None, None))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.timestamp("us")) for i in (0, 1)], names=["low", "high"])

    return listed.mapInArrow(read, "low timestamp_ntz, high timestamp_ntz")


def month_of(time: datetime.datetime) -> datetime.datetime:
    return datetime.datetime(time.year, time.month, 1)


def newest_periods(df: DataFrame, column: str, count: int = 2,
                   start: Callable[[datetime.datetime], datetime.datetime] = month_of) -> list[datetime.datetime]:
    """Where the newest ``count`` periods, months by default, begin that a table has rows of.

    ``df`` is a table of Parquet files as it was read and ``column`` a time without zone
    of it.  The greatest value below a bound is taken from the statistics.  Only if row groups
    lie across the bound are rows read, by a range that is pushed to the scan."""
    bounds = written(row_group_bounds(df, column), "bounds")
    unknown = not bounds.where("high IS NULL").isEmpty()
    found: list[datetime.datetime] = []
    while len(found) < count:
        below = _moment(found[-1]) if found else None
        before = F.lit(True) if below is None else F.col("high") < below
        across = F.lit(False) if below is None else (F.col("high") >= below) & (F.col("low") < below)
        last, hidden = bounds.agg(F.max(F.when(before, F.col("high"))), F.count_if(across)).first()
        if unknown or hidden:
            rows = df.select(F.col(column).alias("t"))
            if below is not None:
                rows = rows.where(F.col("t") < below)
            if last is not None:
                rows = rows.where(F.col("t") >= _moment(last))
            last = rows.agg(F.max("t")).first()[0]
        if last is None:
            break
        found.append(start(last))
    return found


def _moment(time: datetime.datetime) -> Column:
    return F.lit(time.isoformat(sep=" ")).cast("timestamp_ntz")
