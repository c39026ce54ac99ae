"""Queries: choosing sources, quality, merging, cool-down, reachability."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelf.functions import urls
from shelf.operators import cooldown as cooling
from shelf.operators import crawl, merge, quality, select
from shelf.plans import collect as run
from shelf.plans.extraction import text_of
from shelf.plans.feeds import _CASES, _LISTED, captured_feeds, part_pages
from shelf.plans.registry import query, table
from shelf.session import written
from shelf.sources import catalogue, feeds, pages

_ORDER = {"purchase": "collection", "view": "html_listing", "click": "all_products", "signup": "woo"}
_STRATEGY = "CASE event_type WHEN 'purchase' THEN 0 WHEN 'view' THEN 2 WHEN 'click' THEN 3 WHEN 'signup' THEN 6 END"


def strategy_rows(spark, sf_dir):
    """Events as items: user as shop, type as strategy, 'error' as a try that failed."""
    names = F.create_map(*[F.lit(x) for kv in _ORDER.items() for x in kv])
    host = (F.col("event_id") % 7 < 5).cast("int")
    return table(spark, sf_dir, "events").select(
        text_of("shop ", F.col("user_id").cast("string")).alias("roaster"), "event_id", "value",
        names[F.col("event_type")].alias("strategy"), (host * run.HOST).alias("candidate_ord"))


@query("source_cascade", f"""
WITH tries AS (
  SELECT 'shop ' || user_id AS roaster, event_id, CASE WHEN event_id % 7 < 5 THEN 8 ELSE 0 END + {_STRATEGY} AS priority FROM events),
best AS (SELECT roaster, min(priority) AS priority FROM tries GROUP BY 1)
SELECT b.roaster, event_id, CAST(b.priority AS INT) AS priority, 'ok' AS status
FROM best b JOIN tries t ON t.roaster = b.roaster AND t.priority = b.priority
UNION ALL SELECT roaster, NULL, NULL, 'error' FROM best WHERE priority IS NULL""")
def source_cascade(spark, sf_dir):
    rows = strategy_rows(spark, sf_dir)
    items = rows.where("strategy IS NOT NULL").withColumn(
        "priority", run.priority(F.col("strategy"), run.host_of(F.col("candidate_ord"))))
    chosen = select.pick_source(items, ["roaster"], "priority").select(
        "roaster", "event_id", "priority", F.lit("ok").alias("status"))
    lost = rows.select("roaster").distinct().join(items.select("roaster"), "roaster", "left_anti")
    return chosen.unionByName(lost.withColumn("status", F.lit("error")), allowMissingColumns=True)


@query("best_of_source", """
WITH sizes AS (SELECT user_id, event_type, count(*) AS n_rows, min(event_id) AS first FROM events GROUP BY 1, 2),
best AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n_rows DESC, first) AS place FROM sizes)
SELECT e.user_id, e.event_type, e.event_id, b.n_rows FROM events e JOIN best b
ON b.user_id = e.user_id AND b.event_type = e.event_type AND b.place = 1""")
def best_of_source(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("user_id", "event_type", "event_id")
    return select.best_of(rows, ["user_id"], "event_type", "event_id")


@query("first_seen", """
SELECT user_id, event_type, arg_min(event_id, (ts, event_id)) AS event_id, arg_min(value, (ts, event_id)) AS value
FROM events GROUP BY 1, 2""")
def first_seen(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("user_id", "event_type", "event_id", "value", "ts")
    return select.first_per_key(rows, ["user_id", "event_type"], F.struct("ts", "event_id")).drop("ts")


@query("last_wins", """
SELECT user_id, event_type, arg_max(event_id, (ts, event_id)) AS event_id, arg_max(value, (ts, event_id)) AS value
FROM events GROUP BY 1, 2""")
def last_wins(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("user_id", "event_type", "event_id", "value", "ts")
    return select.last_per_key(rows, ["user_id", "event_type"], F.struct("ts", "event_id")).drop("ts")


@query("top_per_shop", """
SELECT user_id, event_id, CAST(place AS INT) AS place FROM (
  SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS place FROM events)
WHERE place <= 3""")
def top_per_shop(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("user_id", "event_id", "value")
    return select.top_per_group(rows, ["user_id"], [F.desc("value"), F.col("event_id")], 3, "place").drop("value")


@query("error_summary", """
WITH failed AS (
  SELECT user_id, event_id, json_extract_string(props, '$.k') AS k,
         row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS place FROM events WHERE event_type = 'error')
SELECT user_id, string_agg('http_' || k, '; ' ORDER BY event_id) AS errors FROM failed WHERE place <= 4 GROUP BY user_id""")
def error_summary(spark, sf_dir):
    failed = table(spark, sf_dir, "events").where("event_type = 'error'").select(
        "user_id", "event_id", text_of("http_", F.get_json_object("props", "$.k")).alias("message"))
    return quality.joined_errors(failed, ["user_id"], "event_id", "message", 4)


@query("collection_run", f"""
WITH {_LISTED},
pairs AS (
  SELECT shop, p_partkey // 2 AS pair, min(p_partkey) AS p_partkey, bool_or(p_size % 3 <> 0) AS in_stock,
         bool_or(p_size % 2 = 1) AS esp, bool_or(p_size % 2 = 0) AS fil FROM paged GROUP BY 1, 2),
numbered AS (SELECT *, CAST(shop AS INT) % 4 AS way FROM listed)
SELECT 'shop ' || shop AS roaster, 'collection' AS strategy, p_name || ' & ' || p_partkey AS bean_name,
       'https://s' || shop || '.example.com/products/p-' || p_partkey AS source_url, 'filter' AS roast_profile, price AS price_aud,
       term AS process, 'Lot ' || p_size || ', Kenya' AS origin, 'plum' AS flavour_profile, '' AS error
FROM numbered WHERE way = 0 AND p_size <> 2 AND p_size % 3 <> 0
UNION ALL
SELECT 'shop ' || g.shop, 'woo', 'Pair ' || pair, 'https://s' || g.shop || '.example.com/shop/' || g.p_partkey,
       CASE WHEN esp AND fil THEN 'omni' WHEN esp THEN 'espresso' ELSE 'filter' END, price, term, '', '', ''
FROM pairs g JOIN numbered p ON p.p_partkey = g.p_partkey WHERE way = 1 AND in_stock
UNION ALL
SELECT 'shop ' || shop, 'wordpress', p_name || ' & ' || p_partkey, 'https://s' || shop || '.example.com/product/' || p_partkey,
       'espresso', price, '', 'Peru', '', '' FROM numbered WHERE way = 2 AND p_size <> 2
UNION ALL
SELECT DISTINCT 'shop ' || shop, NULL, '', 'https://s' || shop || '.example.com/collections/coffee', '', '', '', '', '',
       'https://s' || shop || '.example.com/collections/coffee => shopify_json_http_404 | woocommerce_http_404 | wp_product_http_404'
       || ' | handle_discovery=' || CASE CAST(shop AS INT) % 3 WHEN 0 THEN 'handle_discovery_error' WHEN 1 THEN 'handle_discovery_no_candidates'
            ELSE 'coffee-beans:shopify_json_http_404; tea:shopify_json_no_products' END FROM numbered WHERE way = 3
UNION ALL SELECT DISTINCT 'shop without ' || shop, NULL, '', '', '', '', '', '', '', 'missing_url' FROM listed WHERE CAST(shop AS INT) % 5 = 2""")
def collection_run(spark, sf_dir):
    captured = captured_feeds(spark, sf_dir)
    payloads = captured["collection"].unionByName(captured["woo"]).unionByName(captured["wordpress"])
    # shop 0 answers everything, 1 only the paged feeds, 2 only posts, 3 nothing, and so on
    number = F.substring_index("roaster", " ", -1).try_cast("int")
    answers = (
        F.when(number % 4 == 0, True).when(number % 4 == 1, F.col("strategy") != "collection")
        .when(number % 4 == 2, F.col("strategy") == "wordpress").otherwise(False))
    payloads = payloads.withColumn("http_status", F.when(answers, 200).otherwise(404))
    switches = {"shopify_collection_handle": F.lit(None).cast("string"),
                "price_variant_filter": F.lit("250g"), "force_html_listing": F.lit(False),
                "force_woo_api": number % 4 == 1, "skip_sources": F.lit(None).cast("array<string>"),
                "tag_aliases": F.lit(None).cast("map<string,array<string>>")}
    config = payloads.select("roaster", "listing_url").distinct().withColumns(switches)
    # besides them, every fifth shop once more without an address
    nameless = config.where(number % 5 == 2).withColumns({
        "roaster": F.replace("roaster", F.lit("shop "), F.lit("shop without ")),
        "listing_url": F.lit(None).cast("string"), "force_woo_api": F.lit(False)})
    # the shops that answer nothing have listings: refused, without a handle, or with two that fail
    silent = config.where(number % 4 == 3).select(
        "roaster", "listing_url", F.lit(0).alias("candidate_ord"), F.when(number % 3 == 0, 404).otherwise(200).alias("http_status"),
        F.when(number % 3 == 2, '<a href="/collections/tea">t</a><a href="/collections/All">a</a><a href="/collections/coffee-beans-">c</a>')
        .otherwise('<a href="/collections/all">a</a>').alias("html"))
    handles = pages.discovered_handles(silent).select(
        "roaster", F.lit("discovered_collection").alias("strategy"), (F.col("rank") - 1).alias("candidate_ord"), F.lit(1).alias("page"),
        "listing_url", urls.collection_json_url(F.col("listing_url"), F.col("handle")).alias("url"),
        F.when(F.col("handle") == "tea", 200).otherwise(404).alias("http_status"),
        F.lit("application/json").alias("content_type"), F.lit('{"products": []}').alias("body"))
    payloads = payloads.unionByName(handles)
    config = config.unionByName(nameless)
    products = run.source_products(config, payloads)
    addresses = payloads.select("roaster", "strategy", "candidate_ord", "listing_url").distinct()
    reasons = feeds.feed_reasons(payloads, products).join(addresses, ["roaster", "strategy", "candidate_ord"])
    reasons = reasons.unionByName(pages.discovery_reasons(silent))
    return run.collect(config, products, reasons).select(
        "roaster", "strategy", "bean_name", "source_url", "roast_profile", "price_aud", "process", "origin", "flavour_profile", "error")


@query("sitemap_run", f"""
WITH {_CASES},
parts AS (SELECT *, p_partkey // 50 AS n, 'https://' || CASE WHEN p_partkey // 50 % 2 = 1 THEN 'www.' ELSE '' END || 's' || (p_partkey // 50)
                 || '.example.com' AS root FROM cases)
SELECT 'shop ' || n AS roaster, 'sitemap' AS strategy, CASE WHEN state = 'page' THEN root || '/list' ELSE root || '/products/' || p_partkey END AS source_url,
       CASE WHEN state = 'page' THEN '' ELSE title END AS bean_name, CASE WHEN state = 'page' THEN '' ELSE price END AS price_aud,
       CASE WHEN state = 'page' OR title = '' THEN 'error' ELSE 'ok' END AS status,
       CASE WHEN state = 'page' THEN 'product_page_error: 404' WHEN title = '' THEN 'missing_product_title' ELSE '' END AS error
FROM parts WHERE n % 5 <> 4 AND state NOT IN ('feed', 'blocked')
UNION ALL
SELECT DISTINCT 'shop ' || n, NULL, 'https://s' || n || '.example.com/list', '', '', 'error',
       'https://s' || n || '.example.com/list => sitemap_no_product_urls || https://www.s' || n || '.example.com/list => sitemap_no_product_urls'
FROM parts WHERE n % 5 = 4""")
def sitemap_run(spark, sf_dir):
    # every second shop answers with 'www.' only; every third names its files in robots.txt;
    # every fifth has no files at all
    n = F.floor(F.col("p_partkey") / 50).cast("int")
    root = text_of("https://", F.when(n % 2 == 1, "www.").otherwise(""), "s", n.cast("string"), ".example.com")
    slug = text_of(F.when(F.col("p_size") == 7, "gift-card-").otherwise(""), F.col("p_partkey").cast("string"))
    rows = table(spark, sf_dir, "part").select("p_partkey", n.alias("n"), root.alias("root"), F.concat("root", F.lit("/products/"), slug).alias("url"))
    shop = rows.groupBy("n", "root").agg(F.array_join(F.array_sort(F.collect_list(
        F.concat(F.lit("<loc>"), "url", F.lit("</loc>")))), "").alias("locs"))
    shop = shop.where("n % 5 <> 4")
    hidden = F.col("n") % 3 == 0
    file = F.when(hidden, F.lit("/hidden/list.xml")).otherwise("/product-sitemap1.xml")
    docs = shop.select(F.concat("root", file).alias("url"), F.concat(F.lit("<urlset>"), "locs", F.lit("</urlset>")).alias("body")).union(
        shop.where(hidden).select(F.concat("root", F.lit("/robots.txt")), F.concat(
            F.lit("User-agent: *\r\nsitemap: "), "root", F.lit("/hidden/index\n"))).union(
            shop.where(hidden).select(F.concat("root", F.lit("/hidden/index")), F.concat(F.lit("<loc>"), "root", F.lit("/hidden/list.xml</loc>"))))
    ).withColumn("http_status", F.lit(200))
    moved = F.concat("root", F.regexp_extract("url", "com(/.*)", 1))
    captured = part_pages(spark, sf_dir).withColumn("root", root).withColumn("url", moved).select("url", "http_status", "content_type", "html")
    config = rows.select(text_of("shop ", F.col("n").cast("string")).alias("roaster"),
                         text_of("https://s", F.col("n").cast("string"), ".example.com/list").alias("listing_url")).distinct().withColumns({
        "price_variant_filter": F.lit(None).cast("string"), "skip_sources": F.lit(None).cast("array<string>"),
        "tag_aliases": F.lit(None).cast("map<string,array<string>>")})
    products, reasons = run.sitemap_source(config, docs, captured)
    return run.collect(config, pages.not_skipped(products), reasons).select(
        "roaster", "strategy", "source_url", "bean_name", "price_aud", "status", "error")


# --- quality -------------------------------------------------------------------------------

def judged_documents(spark, sf_dir):
    """Documents with their labels as items: a missing label is an empty field."""
    documents = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    labels = table(spark, sf_dir, "labels")
    return documents.join(labels, "doc_id", "left").select(
        "doc_id", F.when(F.col("quality") == 1, F.col("source")).otherwise(F.lit("  ")).alias("origin"),
        F.col("text").alias("process"), F.when(F.col("toxic").isNotNull(), F.col("lang")).alias("varietal"),
        F.when(F.col("toxic") == 0, "ok").otherwise("").alias("flavour_profile"),
        F.when(F.col("toxic") == 1, "error").otherwise("ok").alias("status"))


_JUDGED = "(SELECT * FROM documents LEFT JOIN labels USING (doc_id) WHERE toxic IS DISTINCT FROM 1)"


@query("quality_completeness", f"""
SELECT 'origin' AS field, count(*) FILTER (WHERE quality IS DISTINCT FROM 1) AS n_empty, count(*) AS n_rows FROM {_JUDGED}
UNION ALL SELECT 'process', count(*) FILTER (WHERE trim(text) = ''), count(*) FROM {_JUDGED}
UNION ALL SELECT 'varietal', count(*) FILTER (WHERE toxic IS NULL), count(*) FROM {_JUDGED}
UNION ALL SELECT 'flavour_profile', count(*) FILTER (WHERE toxic IS DISTINCT FROM 0), count(*) FROM {_JUDGED}""")
def quality_completeness(spark, sf_dir):
    return quality.completeness(quality.good_items(judged_documents(spark, sf_dir)))


@query("quality_contamination", """
SELECT count(*) FILTER (WHERE regexp_matches(lower(text),
  'altitude|producer|region|varieties|variety|masl|notes|tasting|elevation|relationship|oner')) AS n_contaminated,
  count(*) AS n_rows FROM documents WHERE lang <> 'de'""")
def quality_contamination(spark, sf_dir):
    from shelf.vocabulary import CONTAMINANTS

    items = table(spark, sf_dir, "documents").withColumn("status", F.when(F.col("lang") == "de", "error").otherwise("ok"))
    return quality.contamination(
        quality.good_items(items), "text", [*CONTAMINANTS, "oner"])


@query("quality_newly_filled", """
WITH runs AS (
  SELECT o_custkey, date_trunc('month', o_orderdate) AS month, o_orderkey, o_orderstatus <> 'P' AS good,
         CASE WHEN o_orderstatus = 'F' THEN 'x' ELSE ' ' END AS origin,
         CASE WHEN o_totalprice > 200000 THEN 'x' END AS process FROM orders),
months AS (SELECT month, row_number() OVER (ORDER BY month DESC) AS age FROM (SELECT DISTINCT month FROM runs)),
lasts AS (
  SELECT age, o_custkey, trim(arg_max(origin, o_orderkey)) AS origin, arg_max(coalesce(process, ''), o_orderkey) AS process
  FROM runs JOIN months USING (month) WHERE age <= 6 AND good GROUP BY 1, 2),
pairs AS (
  SELECT b.origin = '' AND a.origin <> '' AS origin, b.process = '' AND a.process <> '' AS process
  FROM (SELECT o_custkey, arg_max(origin, -age) AS origin, arg_max(process, -age) AS process FROM lasts WHERE age <= 3 GROUP BY 1) a
  JOIN (SELECT o_custkey, arg_max(origin, -age) AS origin, arg_max(process, -age) AS process FROM lasts WHERE age > 3 GROUP BY 1) b
  USING (o_custkey))
SELECT 'origin' AS field, count(*) FILTER (WHERE origin) AS n_filled FROM pairs
UNION ALL SELECT 'process', count(*) FILTER (WHERE process) FROM pairs""")
def quality_newly_filled(spark, sf_dir):
    # a run is a quarter: the newest three months against the three before
    runs = table(spark, sf_dir, "orders").select(
        "o_custkey", F.date_format("o_orderdate", "yyyy-MM").alias("month"), "o_orderkey",
        F.when(F.col("o_orderstatus") == "P", "error").otherwise("ok").alias("status"),
        F.when(F.col("o_orderstatus") == "F", "x").otherwise(" ").alias("origin"),
        F.when(F.col("o_totalprice") > 200000, "x").alias("process"))
    recent = quality.good_items(select.newest(runs, "month", 6)).withColumn(
        "ord", F.struct("month", "o_orderkey"))
    return quality.newly_filled(
        recent.where("age > 3"), recent.where("age <= 3"), ["o_custkey"], "ord", ["origin", "process"])


@query("health_alert", """
SELECT count(DISTINCT user_id) FILTER (WHERE event_type = 'error') AS failing_shops,
       count(DISTINCT user_id) FILTER (WHERE event_type = 'error') >= 3 AS alert FROM events""")
def health_alert(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select(
        F.col("user_id").cast("string").alias("roaster"),
        F.when(F.col("event_type") == "error", "error").otherwise("ok").alias("status"))
    return quality.health_alert(rows)


# --- favourites ---------------------------------------------------------------------------------

def changes(spark, sf_dir):
    """Events as favourite changes: the type 'error' deletes."""
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("code"), F.get_json_object("props", "$.k").alias("key"), "ts",
        (F.col("event_type") == "error").alias("deleted"), "event_id", "value")


_LWW = """
WITH changes AS (
  SELECT user_id AS code, json_extract_string(props, '$.k') AS key, ts, event_type = 'error' AS deleted, event_id, value FROM events),
latest AS (
  SELECT code, key, arg_max(deleted, (ts, deleted, event_id)) AS deleted, arg_max(event_id, (ts, deleted, event_id)) AS event_id,
         arg_max(value, (ts, deleted, event_id)) AS value FROM changes GROUP BY 1, 2)
SELECT code, key, event_id, value FROM latest WHERE NOT deleted"""


@query("lww_merge", _LWW)
def lww_merge(spark, sf_dir):
    merged = merge.last_write(changes(spark, sf_dir), ["code", "key"], ["ts", "deleted", "event_id"])
    return merged.select("code", "key", "event_id", "value")


@query("doc_validation", """
SELECT event_id, CASE event_id % 10 WHEN 1 THEN 'bad_code' WHEN 2 THEN 'bad_json' WHEN 3 THEN 'bad_shape' WHEN 4 THEN 'bad_shape'
  WHEN 5 THEN 'bad_shape' WHEN 6 THEN 'bad_shape' WHEN 7 THEN 'too_large' END AS reject_reason,
  CASE WHEN event_id % 10 IN (0, 8, 9) THEN CASE WHEN event_id % 10 = 9 THEN 0 ELSE CAST(json_extract_string(props, '$.k') AS INT) END END AS n
FROM events""")
def doc_validation(spark, sf_dir):
    way, k = F.col("event_id") % 10, F.get_json_object("props", "$.k")
    code = F.md5(F.col("user_id").cast("string"))
    good = text_of('{"items": {"a": ', F.col("props"), '}, "tombstones": {"b": ', k, '.5e0}, "updated_at": ', k, "}")
    body = (
        # not closed, with more behind it, or in quotes that JSON has not
        F.when(way == 2, F.when(F.col("event_id") % 20 == 2, text_of("{", F.col("props"))).when(
            F.col("event_id") % 40 == 12, F.concat(good, F.lit(" trailing"))).otherwise(text_of("{'items': {'a': {'n': ", k, "}}}")))
        # of a repeated member the last counts, and it has to have the shape
        .when(way == 3, F.when(F.col("event_id") % 20 == 3, text_of('{"items": {"a": ', k, "}}")).otherwise(
            text_of('{"items": {"a": {}}, "tombstones": {}, "tombstones": {"b": "', k, '"}}')))
        .when(way == 4, F.when(F.col("event_id") % 20 == 4, text_of('{"items": {}, "tombstones": {"b": "', k, '"}}')).otherwise(
            text_of('{"items": {"a": {}}, "items": {"a": ', F.col("props"), '}, "tombstones": null}')))
        .when(way == 5, text_of("[", good, "]"))
        .when(way == 6, text_of('{"items": {"a": ', F.col("props"), '}, "tombstones": null}'))
        .when(way == 7, F.concat(good, F.repeat(F.lit("\U0001f600"), 500)))
        .when(way == 9, text_of('{"items": {"a": ', F.col("props"), '}, "x": null}'))
        .when(way == 8, text_of('{"items": {"a": 1}, "items": {"a": ', F.col("props"), '}, "updated_at": ', k, "}"))
        .otherwise(good))
    rows = table(spark, sf_dir, "events").select(
        "event_id", F.when(way == 1, F.upper(code)).otherwise(code).alias("code"), body.alias("body"))
    checked = rows.withColumn("reject_reason", merge.reject_reason(F.col("code"), F.col("body"), 1000))
    good_docs = catalogue.favourites(checked.where("reject_reason IS NULL"), "event_id").select(
        "event_id", F.col("updated_at").cast("int").alias("n"))
    return checked.select("event_id", "reject_reason").join(good_docs, "event_id", "left")


@query("favourites_maps", """
WITH k AS (SELECT event_id, json_extract_string(props, '$.k') AS k FROM events)
SELECT event_id, 'item' AS kind, 'a' AS key, '{"k":' || k || '}' AS value FROM k WHERE event_id % 3 <> 1
UNION ALL SELECT event_id, 'item', 'b', '{}' FROM k WHERE event_id % 3 <> 1
UNION ALL SELECT event_id, 'tombstone', 'c', CAST(CAST(k AS DOUBLE) + 0.5 AS VARCHAR) FROM k WHERE event_id % 3 <> 2
UNION ALL SELECT event_id, 'updated', '', CASE WHEN event_id % 3 = 0 THEN k ELSE '0' END FROM k""")
def favourites_maps(spark, sf_dir):
    k, way = F.get_json_object("props", "$.k"), F.col("event_id") % 3
    items = F.when(way != 1, text_of('"items": {"a": ', F.col("props"), ', "b": {}}'))
    graves = F.when(way != 2, text_of('"tombstones": {"c": ', k, ".5}"))
    stamp = F.when(way == 0, text_of('"updated_at": ', k))
    docs = table(spark, sf_dir, "events").select(
        "event_id", F.concat(F.lit("{"), F.concat_ws(", ", items, graves, stamp), F.lit("}")).alias("body"))
    read = written(catalogue.favourites(docs, "event_id"), "favourites")
    kept = read.select("event_id", F.lit("item").alias("kind"), F.explode("items").alias("key", "value"))
    gone = read.select("event_id", F.lit("tombstone"), F.explode("tombstones"))
    when = read.select("event_id", F.lit("updated"), F.lit(""), F.col("updated_at").cast("string"))
    return kept.union(gone.withColumn("value", F.col("value").cast("string"))).union(when)


_HOUR = 3600


@query("cooldown", """
WITH RECURSIVE e AS (SELECT user_id, event_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
accepted AS (
  SELECT user_id, event_id, ts, n FROM e WHERE n = 1
  UNION ALL
  SELECT user_id, event_id, ts, n FROM (
    SELECT e.user_id, e.event_id, e.ts, e.n, row_number() OVER (PARTITION BY e.user_id ORDER BY e.n) AS r
    FROM accepted a JOIN e ON e.user_id = a.user_id AND e.n > a.n AND e.ts >= a.ts + INTERVAL 18 HOUR) WHERE r = 1)
SELECT user_id, event_id FROM accepted""")
def cooldown(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("user_id", "event_id", "ts")
    return cooling.cooldown(events, "user_id", "ts", "event_id", 18 * _HOUR, span_gaps=4).select(
        "user_id", "event_id")


# --- reachability ---------------------------------------------------------------------------------

@query("bfs_reach", """
SELECT 'r' || r_regionkey AS node, 0 AS depth FROM region
UNION ALL SELECT 'n' || n_nationkey, 1 FROM nation
UNION ALL SELECT 'c' || c_custkey, 2 FROM customer
UNION ALL SELECT 'o' || o_orderkey, 3 FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer)""")
def bfs_reach(spark, sf_dir):
    def named(prefix, column):
        return F.concat(F.lit(prefix), F.col(column).cast("string"))

    def edge(name, src, dst):
        return table(spark, sf_dir, name).select(src.alias("src"), dst.alias("dst"))

    edges = (
        edge("nation", named("r", "n_regionkey"), named("n", "n_nationkey"))
        .unionByName(edge("customer", named("n", "c_nationkey"), named("c", "c_custkey")))
        .unionByName(edge("orders", named("c", "o_custkey"), named("o", "o_orderkey")))
        # back to the region, so there are cycles to be ended
        .unionByName(edge("customer", named("c", "c_custkey"), F.lit("r0"))))
    seeds = table(spark, sf_dir, "region").select(named("r", "r_regionkey").alias("node"))
    return crawl.reach(edges, seeds)
