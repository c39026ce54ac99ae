"""Queries: snapshots, new arrivals, publishing and sinks."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelf.functions.text import key_text
from shelf.operators import diff, publish, select
from shelf.plans.registry import query, table
from shelf.plans.views import HIDDEN_SHOP, OFFERS, newest_offers, offers, shipped
from shelf.session import new_folder, written
from shelf.sinks import files
from shelf.sources import catalogue, documents, statistics

_PUBLISHED = f"""
WITH {OFFERS},
shown AS (SELECT * FROM keyed WHERE age = 1 AND status <> 'error' AND lower(roaster) <> 'brand#7'),
before AS (SELECT DISTINCT key FROM keyed WHERE age = 2)
"""


def published(spark, sf_dir):
    latest, previous = newest_offers(spark, sf_dir)
    return publish.published_items(latest, previous, (HIDDEN_SHOP,))


@query("new_arrivals", _PUBLISHED + """
SELECT roaster, bean_name, url, roast_profile, '' AS origin, price_aud, '' AS process,
       p_type AS varietal, p_name AS flavour_profile, key NOT IN (SELECT key FROM before) AS is_new
FROM shown ORDER BY is_new DESC, roaster, bean_name, ord""")
def new_arrivals(spark, sf_dir):
    return publish.in_publish_order(published(spark, sf_dir))


@query("new_arrivals_history", f"""
WITH {OFFERS},
seen AS (SELECT DISTINCT snapshot, roaster, lower(p_name) || ' - ' || lower(p_type) AS bean FROM offers),
numbered AS (SELECT *, dense_rank() OVER (ORDER BY snapshot) AS seq FROM seen)
SELECT n.snapshot, lower(n.roaster) AS key_roaster, n.bean AS key_bean, b.seq IS NULL AS is_new
FROM numbered n LEFT JOIN numbered b ON b.seq = n.seq - 1 AND b.roaster = n.roaster AND b.bean = n.bean""")
def new_arrivals_history(spark, sf_dir):
    # names repeat far more than rows, so keys are built on distinct spellings
    spelled = offers(spark, sf_dir).select("snapshot", "roaster", "bean_name").distinct()
    keys = diff.publish_key()
    return diff.arrivals_by_snapshot(spelled.withColumns(keys), list(keys), "snapshot")


_IDENTITY = "CASE WHEN url <> '' THEN url ELSE roaster || '::' || replace(bean_name, '&#45;', '-') END"


@query("identity_difference", f"""
WITH {OFFERS}, named AS (SELECT *, {_IDENTITY} AS identity FROM keyed)
SELECT DISTINCT identity FROM named WHERE age = 1 AND status = 'ok'
EXCEPT SELECT identity FROM named WHERE age = 2""")
def identity_difference(spark, sf_dir):
    latest, previous = newest_offers(spark, sf_dir)
    named = [df.withColumn("identity", diff.item_identity()) for df in (latest, previous)]
    return diff.new_keys(named[0].where("status = 'ok'"), named[1], "identity")


@query("new_row_flags", f"""
WITH {OFFERS}, named AS (SELECT *, {_IDENTITY} AS identity FROM keyed)
SELECT ord, roaster, status, status = 'ok' AND identity NOT IN (SELECT identity FROM named WHERE age = 2) AS is_new
FROM named WHERE age = 1""")
def new_row_flags(spark, sf_dir):
    latest, previous = newest_offers(spark, sf_dir)
    return diff.flag_new_rows(latest, previous).select("ord", "roaster", "status", "is_new")


@query("publish_stats", _PUBLISHED + """
SELECT count(*) AS total, count(*) FILTER (WHERE key NOT IN (SELECT key FROM before)) AS new,
       count(DISTINCT roaster) AS roasters FROM shown""")
def publish_stats(spark, sf_dir):
    return publish.publish_stats(published(spark, sf_dir))


@query("published_shops", _PUBLISHED + "SELECT DISTINCT roaster FROM shown ORDER BY roaster")
def published_shops(spark, sf_dir):
    return publish.published_shops(published(spark, sf_dir))


_YEARLY = """
WITH runs AS (
  SELECT strftime(o_orderdate, '%Y') AS snapshot,
         CASE o_orderstatus WHEN 'F' THEN 'ok' WHEN 'O' THEN 'error' ELSE 'skip' END AS status,
         CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'filter' WHEN '2' THEN 'espresso'
              WHEN '3' THEN 'omni' ELSE 'unknown' END AS bucket
  FROM orders)
"""


def yearly_runs(spark, sf_dir):
    level = F.substring("o_orderpriority", 1, 1)
    return table(spark, sf_dir, "orders").select(
        F.date_format("o_orderdate", "yyyy").alias("snapshot"),
        F.when(F.col("o_orderstatus") == "F", "ok").when(F.col("o_orderstatus") == "O", "error")
        .otherwise("skip").alias("status"),
        F.when(level == "1", "filter").when(level == "2", "espresso").when(level == "3", "omni")
        .when(level == "4", "Espresso").otherwise("").alias("roast_profile"))


@query("snapshot_summary", _YEARLY + """
SELECT snapshot, count(*) AS total_rows, count(*) FILTER (WHERE status = 'ok') AS ok_rows,
       count(*) FILTER (WHERE status = 'error') AS error_rows FROM runs GROUP BY snapshot""")
def snapshot_summary(spark, sf_dir):
    return publish.snapshot_summary(yearly_runs(spark, sf_dir), ["snapshot"])


@query("roast_buckets", _YEARLY + """
SELECT snapshot, bucket, count(*) AS n_items FROM runs GROUP BY snapshot, bucket""")
def roast_buckets(spark, sf_dir):
    bucketed = publish.with_bucket(yearly_runs(spark, sf_dir))
    return bucketed.groupBy("snapshot", "bucket").agg(F.count("*").alias("n_items"))


@query("retention", """
SELECT DISTINCT strftime(l_shipdate, '%Y-%m') AS snapshot FROM lineitem
EXCEPT (SELECT snapshot FROM (SELECT DISTINCT strftime(l_shipdate, '%Y-%m') AS snapshot FROM lineitem)
        ORDER BY snapshot DESC LIMIT 2)""")
def retention(spark, sf_dir):
    return select.expired(shipped(spark, sf_dir), "snapshot", 2)


@query("timestamp_reformat", """
SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN 'run ' || o_orderkey
  ELSE strftime(o_orderdate, '%Y-%m-%d') || ' ' || lpad(CAST(o_orderkey % 24 AS VARCHAR), 2, '0') || ':'
       || lpad(CAST(o_orderkey % 60 AS VARCHAR), 2, '0') END AS generated_at
FROM orders""")
def timestamp_reformat(spark, sf_dir):
    key = F.col("o_orderkey")
    two = lambda n: F.lpad((key % n).cast("string"), 2, "0")
    stamp = F.concat(F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit("_"), two(24), two(60), two(60))
    raw = F.when(key % 7 == 0, F.concat(F.lit("run "), key.cast("string"))).otherwise(stamp)
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", publish.published_time(raw).alias("generated_at"))


@query("key_normalise", """
SELECT c_custkey, 'customer-' || lpad(CAST(c_custkey AS VARCHAR), 9, '0') || ' & co '
       || lower(c_mktsegment) AS key
FROM customer""")
def key_normalise(spark, sf_dir):
    custom = table(spark, sf_dir, "customer")
    dashes = F.array(*[F.lit(d) for d in "–—‐‑‒―-－"])
    dash = F.element_at(dashes, (F.col("c_custkey") % 8 + 1).cast("int"))
    name = F.concat(F.substring_index("c_name", "#", 1), dash, F.substring_index("c_name", "#", -1))
    raw = F.concat(
        F.lit(" "), F.when(F.col("c_custkey") % 2 == 0, F.upper(name)).otherwise(name),
        F.lit(" &amp;  "), F.lit("ＣＯ"), F.lit("\t"), "c_mktsegment")
    return custom.select("c_custkey", key_text(raw).alias("key"))


@query("snapshot_sink", f"""
WITH {OFFERS}
SELECT snapshot, CASE WHEN roast_profile IN ('filter', 'espresso', 'omni') THEN roast_profile
                      ELSE 'unknown' END AS bucket,
       count(*) AS n_items, count(*) FILTER (WHERE status = 'error') AS n_errors
FROM offers GROUP BY 1, 2""")
def snapshot_sink(spark, sf_dir):
    folder = new_folder(spark, "snapshots")
    files.write_snapshot(offers(spark, sf_dir), folder)
    # partition values are read as text, as they were written
    items = spark.read.schema("status STRING, snapshot STRING, bucket STRING").parquet(f"{folder}/items")
    return items.groupBy("snapshot", "bucket").agg(
        F.count("*").alias("n_items"), F.count_if(F.col("status") == "error").alias("n_errors"))


@query("snapshot_scan", f"""
WITH {OFFERS}
SELECT DISTINCT snapshot, roaster, ord, key NOT IN (SELECT key FROM keyed WHERE age = 2) AS is_new FROM keyed WHERE age = 1""")
def snapshot_scan(spark, sf_dir):
    # snapshots as the sink writes them; only the folders of the newest two are read
    folder = new_folder(spark, "snapshots")
    files.write_snapshot(offers(spark, sf_dir), folder)
    snapshots = catalogue.written_snapshots(spark, folder)
    recent = select.newest(snapshots, "snapshot", 2, statistics.partition_names(snapshots, "snapshot")).withColumns(diff.publish_key())
    return diff.flag_new(recent.where("age = 1"), recent.where("age = 2"), list(diff.publish_key())).select(
        "snapshot", "roaster", F.col("ord").cast("long").alias("ord"), "is_new").distinct()


@query("snapshot_documents", f"""
WITH {OFFERS}
SELECT 'list_' || snapshot || '.json' AS snapshot, snapshot AS generated_at,
       CAST(row_number() OVER (PARTITION BY snapshot ORDER BY ord) - 1 AS INT) AS ord, roaster, source_url, bean_name, status,
       key NOT IN (SELECT key FROM keyed WHERE age = 2) AS is_new
FROM (SELECT *, url AS source_url FROM keyed WHERE age = 1)""")
def snapshot_documents(spark, sf_dir):
    # a document for every month; only the newest two are opened
    folder = new_folder(spark, "documents")
    files.write_documents(offers(spark, sf_dir), folder)
    recent = select.newest(documents.read_documents(spark, folder, newest=2), "snapshot", 2)
    recent = written(recent.withColumns(diff.publish_key()), "recent")
    return diff.flag_new(recent.where("age = 1"), recent.where("age = 2"), list(diff.publish_key())).select(
        "snapshot", "generated_at", "ord", "roaster", "source_url",
        F.regexp_replace("bean_name", " +", " ").alias("bean_name"), "status", "is_new")


@query("published_sink", _PUBLISHED + """
SELECT roaster, bean_name, url, price_aud, key NOT IN (SELECT key FROM before) AS is_new,
       (SELECT count(*) FROM shown) AS total, '2026-02-27 20:01' AS generated_at,
       (SELECT string_agg(roaster, '|' ORDER BY roaster) FROM (SELECT DISTINCT roaster FROM shown)) AS roasters FROM shown""")
def published_sink(spark, sf_dir):
    folder = new_folder(spark, "published")
    files.write_published(published(spark, sf_dir), F.lit("2026-02-27 20:01"), folder)
    items = spark.read.schema(
        "roaster STRING, bean_name STRING, url STRING, price_aud STRING, is_new BOOLEAN"
    ).json(f"{folder}/items")
    stats = spark.read.schema("total LONG, generated_at STRING").json(f"{folder}/stats")
    shops = spark.read.schema("roaster STRING").json(f"{folder}/roasters").agg(
        F.array_join(F.array_sort(F.collect_list("roaster")), "|").alias("roasters"))
    return items.join(F.broadcast(stats)).join(F.broadcast(shops))


@query("csv_sink", f"""
WITH {OFFERS}
SELECT roaster, CASE WHEN url = '' THEN '' ELSE '=HYPERLINK("' || url || '","'
         || replace(bean_name, '&#45;', '-') || '")' END AS bean_name,
       roast_profile, '' AS origin, price_aud, '' AS process, '<i>' || p_type || '</i>' AS varietal,
       p_name AS flavour_profile, status,
       CASE WHEN status = 'error' THEN 'missing_product_title' ELSE '' END AS error
FROM keyed WHERE age = 1""")
def csv_sink(spark, sf_dir):
    folder = new_folder(spark, "csv")
    latest, _ = newest_offers(spark, sf_dir)
    files.write_csv(latest, folder)
    return files.read_csv(spark, folder)
