"""Newest names and dates without a scan."""

import datetime

from pyspark.sql import functions as F

from shelf.operators import select
from shelf.sources import statistics


def jobs(spark, group, work):
    """How many jobs a piece of work runs."""
    sc = spark.sparkContext
    sc.setJobGroup(group, group)
    try:
        out = work()
        return out, len(sc.statusTracker().getJobIdsForGroup(group))
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)


def test_partition_names(spark, tmp_path):
    rows = spark.createDataFrame([("2026-01 x", 1), ("2026-02", 2), ("2026-03", 3)], "snapshot string, n int")
    rows.write.partitionBy("snapshot").parquet(str(tmp_path / "t"))
    df = spark.read.option("basePath", str(tmp_path / "t")).parquet(str(tmp_path / "t"))
    names, n = jobs(spark, "names", lambda: statistics.partition_names(df, "snapshot"))
    assert names == ["2026-01 x", "2026-02", "2026-03"] and n == 0
    recent = select.newest(df, "snapshot", 2, names)
    assert {(r.snapshot, r.age) for r in recent.collect()} == {("2026-03", 1), ("2026-02", 2)}
    plan = recent._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "2026-03" in plan
    rows.write.parquet(str(tmp_path / "flat"))
    assert statistics.partition_names(spark.read.parquet(str(tmp_path / "flat")), "snapshot") is None


def times(spark, tmp_path, name, months):
    """A table with a file for each list of months; None is a null."""
    for i, some in enumerate(months):
        values = [(None if m is None else datetime.datetime(2026, m, 5, 12),) for m in some]
        spark.createDataFrame(values, "t timestamp_ntz").coalesce(1).write.mode("append").parquet(str(tmp_path / name))
    return spark.read.parquet(str(tmp_path / name))


def test_newest_months(spark, tmp_path):
    clustered = times(spark, tmp_path, "a", [[1, 2], [3], [5, 5], [None]])
    assert statistics.newest_periods(clustered, "t") == [datetime.datetime(2026, 5, 1), datetime.datetime(2026, 3, 1)]
    mixed = times(spark, tmp_path, "b", [[1, 5], [2, 3, None], [2]])
    assert statistics.newest_periods(mixed, "t") == [datetime.datetime(2026, 5, 1), datetime.datetime(2026, 3, 1)]
    hidden = times(spark, tmp_path, "c", [[1, 4, 5], [2, 3]])
    assert statistics.newest_periods(hidden, "t", 3) == [datetime.datetime(2026, m, 1) for m in (5, 4, 3)]
    assert statistics.newest_periods(times(spark, tmp_path, "d", [[None], [4]]), "t") == [datetime.datetime(2026, 4, 1)]


def test_clustered_tables_are_not_scanned(spark, tmp_path, monkeypatch):
    df = times(spark, tmp_path, "e", [[1], [2], [3]])
    # rows would be read through the table; only its file names are needed
    monkeypatch.setattr(type(df), "select", lambda *_: (_ for _ in ()).throw(AssertionError("rows were read")))
    assert statistics.newest_periods(df, "t") == [datetime.datetime(2026, 3, 1), datetime.datetime(2026, 2, 1)]


def test_range_is_pushed(spark, tmp_path):
    df = times(spark, tmp_path, "f", [[1, 4, 5]])
    plan = df.where(F.col("t") < F.lit("2026-05-01 00:00:00").cast("timestamp_ntz"))._jdf.queryExecution().executedPlan().toString()
    assert "LessThan(t," in plan
