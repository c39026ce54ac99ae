"""Queries: the incremental forms, each run over data that lands in steps."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelf.operators import merge
from shelf.plans.registry import query, table
from shelf.plans.selection import _HOUR, _LWW, changes
from shelf.plans.views import shipped
from shelf.session import new_folder
from shelf.streaming import arrivals, base, expiring, spans


def in_steps(df, folder, step, number, follow):
    """Land the rows of one step after the other and follow the stream after each."""
    for i in range(number):
        df.where(step == i).write.mode("append").parquet(f"{folder}/landing/step{i}")
        follow(base.landing(df.sparkSession, f"{folder}/landing", df.schema))


@query("incremental_arrivals", """
WITH seen AS (SELECT DISTINCT strftime(l_shipdate, '%Y-%m') AS snapshot, l_partkey AS p_partkey FROM lineitem),
numbered AS (SELECT *, dense_rank() OVER (ORDER BY snapshot) AS seq FROM seen)
SELECT n.snapshot, n.p_partkey, b.seq IS NULL AS is_new
FROM numbered n LEFT JOIN numbered b ON b.seq = n.seq - 1 AND b.p_partkey = n.p_partkey""")
def incremental_arrivals(spark, sf_dir):
    folder = new_folder(spark, "arrivals")
    year = F.substring("snapshot", 1, 4)
    step = F.when(year < "1997", 0).when(year < "2000", 1).otherwise(2)
    in_steps(shipped(spark, sf_dir), folder, step, 3,
             lambda stream: arrivals.follow_arrivals(stream, folder, ["p_partkey"], "snapshot"))
    return arrivals.read_arrivals(spark, folder).select("snapshot", "p_partkey", "is_new")


def day_step():
    return F.floor((F.dayofmonth("ts") - 1) / 16).cast("int")


def follow_writes(rows, folder, steps, days):
    """Land the changes step by step, each ``days`` after the one before, and merge them."""
    written = F.timestamp_micros(F.lit(1_700_000_000_000_000) + F.col("step") * (days * 86_400_000_000))
    follow = lambda stream: expiring.follow_favourites(
        stream.withColumn("written_at", written).drop("step"), "code", "key", ["ts", "deleted", "event_id"],
        "written_at", base.append_batches(f"{folder}/log"), f"{folder}/checkpoint")
    in_steps(rows.withColumn("ts", merge.micros("ts")), folder, F.col("step"), steps, follow)
    log = rows.sparkSession.read.parquet(f"{folder}/log")
    return expiring.merged_favourites(log, ["code", "key"]).select("code", "key", "event_id", "value")


@query("lww_stream", _LWW)
def lww_stream(spark, sf_dir):
    # the later half lands first, so that much of what follows comes too late
    rows = changes(spark, sf_dir).withColumn("step", 1 - day_step())
    return follow_writes(rows, new_folder(spark, "favourites"), 2, 1)


@query("favourites_expiry", """
WITH changes AS (
  SELECT user_id AS code, json_extract_string(props, '$.k') AS key, ts, event_type = 'error' AS deleted, event_id, value,
         CASE user_id % 5 WHEN 0 THEN 0 WHEN 1 THEN 3 * (event_id % 2) WHEN 2 THEN event_id % 2 WHEN 3 THEN 1 + 2 * (event_id % 2)
                          ELSE 2 + event_id % 2 END AS step FROM events),
steps AS (SELECT DISTINCT code, step FROM changes),
gaps AS (SELECT *, coalesce(200 * (step - lag(step) OVER (PARTITION BY code ORDER BY step)) > 365, true) AS anew FROM steps),
alive AS (SELECT code, max(step) FILTER (WHERE anew) AS since FROM gaps GROUP BY 1 HAVING 200 * ((SELECT max(step) FROM steps) - max(step)) <= 365),
latest AS (
  SELECT code, key, arg_max(deleted, (ts, deleted, event_id)) AS deleted, arg_max(event_id, (ts, deleted, event_id)) AS event_id,
         arg_max(value, (ts, deleted, event_id)) AS value FROM changes JOIN alive USING (code) WHERE step >= since GROUP BY 1, 2)
SELECT code, key, event_id, value FROM latest WHERE NOT deleted""")
def favourites_expiry(spark, sf_dir):
    # fifths of the owners write at other times: some stop for good, some for over a year
    odd, fifth = F.col("event_id") % 2, F.col("code") % 5
    step = F.when(fifth == 0, F.lit(0)).when(fifth == 1, 3 * odd).when(fifth == 2, odd).when(fifth == 3, 1 + 2 * odd).otherwise(2 + odd)
    rows = changes(spark, sf_dir).withColumn("step", step.cast("int"))
    return follow_writes(rows, new_folder(spark, "favourites"), 4, 200)


def cooldown_sql(owner):
    return f"""
WITH RECURSIVE o AS (SELECT {owner} AS user_id, event_id, ts FROM events),
e AS (SELECT user_id, event_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM o),
accepted AS (
  SELECT user_id, event_id, ts, n FROM e WHERE n = 1
  UNION ALL
  SELECT user_id, event_id, ts, n FROM (
    SELECT e.user_id, e.event_id, e.ts, e.n, row_number() OVER (PARTITION BY e.user_id ORDER BY e.n) AS r
    FROM accepted a JOIN e ON e.user_id IS NOT DISTINCT FROM a.user_id AND e.n > a.n AND e.ts >= a.ts + INTERVAL 18 HOUR) WHERE r = 1)
SELECT user_id, event_id FROM accepted"""


def cooled_down(spark, sf_dir, owner, span_gaps):
    folder = new_folder(spark, "cooldown")
    rows = table(spark, sf_dir, "events").select(
        owner.alias("user_id"), "event_id", merge.micros("ts").alias("micros"), day_step().alias("step"))
    in_steps(rows, folder, F.col("step"), 2, lambda stream: spans.follow_cooldown(
        stream.drop("step"), "user_id", "micros", "event_id", base.append_batches(f"{folder}/kept"),
        folder, 18 * _HOUR, span_gaps))
    return spark.read.parquet(f"{folder}/kept").select("user_id", "event_id")


@query("cooldown_stream", cooldown_sql("user_id"))
def cooldown_stream(spark, sf_dir):
    return cooled_down(spark, sf_dir, F.col("user_id"), 64)


@query("cooldown_hot_stream", cooldown_sql("CASE WHEN event_id % 10 = 0 THEN user_id END"))
def cooldown_hot_stream(spark, sf_dir):
    # nine in ten events have one owner, none; its backlog is dealt over tasks by spans
    return cooled_down(spark, sf_dir, F.when(F.col("event_id") % 10 == 0, F.col("user_id")), 4)


@query("favourites_log", """
WITH docs AS (SELECT user_id AS code, event_type = 'error' AS gone, json_extract_string(props, '$.k') AS k,
                     epoch_us(ts) AS micros FROM events),
latest AS (SELECT code, k AS key, max(micros) FILTER (WHERE NOT gone) AS kept, max(micros) FILTER (WHERE gone) AS lost FROM docs GROUP BY 1, 2)
SELECT code, key, CAST(kept AS DOUBLE) AS ts FROM latest WHERE kept IS NOT NULL AND (lost IS NULL OR kept > lost)""")
def favourites_log(spark, sf_dir):
    # every event is a device's document with one item or one tombstone
    at = merge.micros("ts").cast("double")
    gone, key = F.col("event_type") == "error", F.get_json_object("props", "$.k")
    docs = table(spark, sf_dir, "events").select(
        F.col("user_id").alias("code"),
        F.when(~gone, F.create_map(key, F.concat(F.lit('{"ts": '), at.cast("long").cast("string"), F.lit("}")))).alias("items"),
        F.when(gone, F.create_map(key, at)).alias("tombstones"))
    merged = merge.last_write(merge.favourite_changes(docs), ["code", "key"], ["ts", "deleted"])
    return merged.select("code", "key", "ts")
