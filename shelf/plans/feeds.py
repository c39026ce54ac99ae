"""Queries: captured feeds and pages, prices and stock."""

from __future__ import annotations

import functools

from pyspark.sql import Window
from pyspark.sql import functions as F

from shelf.functions import fields, prices
from shelf.operators import crawl, extract, select
from shelf.plans.extraction import TERMS, choose, pick, sql_pick, text_of
from shelf.plans.registry import query, table
from shelf.session import spread, written
from shelf.sources import catalogue, feeds, pages
from shelf.functions.guards import origin_guard

# A shop of these feeds holds 700 parts in 7 pages of 100, the first shop one less.
_TERM = sql_pick(TERMS, "p_size")
_LISTED = f"""
listed AS (
  SELECT *, CAST(p_partkey // 700 AS VARCHAR) AS shop, p_partkey % 700 // 100 + 1 AS page, {_TERM} AS term,
         CAST(CAST(p_retailprice AS DECIMAL(10, 2)) AS VARCHAR) AS price
  FROM part),
paged AS (SELECT * FROM listed)
"""


def listed_parts(spark, sf_dir):
    key = F.col("p_partkey")
    return table(spark, sf_dir, "part").withColumns({
        "shop": F.floor(key / 700).cast("string"),
        "page": (F.floor(key % 700 / 100) + 1).cast("int"),
        "term": pick(TERMS, F.col("p_size")),
        "price": F.col("p_retailprice").cast("decimal(10,2)").cast("string"),
        "name": text_of("<b>", F.when(F.col("p_size") == 2, F.lit("Tote Bags for a tote")).otherwise(F.col("p_name")),
                        "</b> &amp; ", key.cast("string")),
    })


def as_payloads(rows, strategy, product, by, body=None):
    """Render feeds: the products of a shop's page, in order, as one JSON body."""
    ordered = F.transform(
        F.array_sort(F.collect_list(F.struct("p_partkey", product.alias("p")))), lambda e: e.p)
    groups = rows.groupBy("shop", *by).agg(F.to_json(body(ordered) if body else ordered).alias("body"))
    root = text_of("https://s", F.col("shop"), ".example.com")
    named = {c: F.col(c) for c in by}
    return groups.select(
        F.concat(F.lit("shop "), F.col("shop")).alias("roaster"), F.lit(strategy).alias("strategy"),
        named.get("candidate_ord", F.lit(0)).alias("candidate_ord"), named.get("page", F.lit(1)).alias("page"),
        text_of(root, "/collections/coffee").alias("listing_url"), root.alias("url"),
        F.lit(200).alias("http_status"), F.lit("application/json").alias("content_type"), "body")


def collection_product():
    key, size = F.col("p_partkey").cast("string"), F.col("p_size")
    available = F.when(size % 3 == 0, F.lit(False)).when(size % 3 == 1, F.lit(True))
    variants = F.array(
        F.struct(F.lit("1kg").alias("title"), F.lit("1.00").alias("price"), F.lit(False).alias("available")),
        F.struct(F.lit("Bag 250G").alias("title"), F.col("price").alias("price"), available.alias("available")))
    return F.struct(
        F.col("name").alias("title"), text_of("p-", key).alias("handle"),
        F.array(text_of("Process: ", F.col("term")), F.lit("Brew Method.V60")).alias("tags"),
        text_of("<p>Origin: Lot ", size.cast("string"), ", Kenya</p><p>Notes: plum</p>").alias("body_html"),
        variants.alias("variants"))


def woo_product():
    size = F.col("p_size")
    link = text_of("https://s", F.col("shop"), ".example.com/shop/", F.col("p_partkey").cast("string"))
    return F.struct(
        text_of("Pair ", F.floor(F.col("p_partkey") / 2).cast("string")).alias("name"), link.alias("permalink"),
        F.when(size % 3 == 0, F.lit(False)).alias("is_in_stock"), F.lit("").alias("short_description"),
        text_of("<p>Process: ", F.col("term"), "</p>").alias("description"),
        F.array(F.struct(F.when(size % 2 == 0, "Filter beans").otherwise("Espresso &amp; more").alias("name"))).alias("categories"),
        F.struct(F.translate("price", ".", "").alias("price"), F.lit(2).alias("currency_minor_unit")).alias("prices"))


def wordpress_product():
    link = text_of("https://s", F.col("shop"), ".example.com/product/", F.col("p_partkey").cast("string"))
    return F.struct(
        F.struct(F.col("name").alias("rendered")).alias("title"), link.alias("link"),
        F.struct(F.lit("<p>for espresso</p>").alias("rendered")).alias("excerpt"),
        F.struct(text_of("<p>now $", F.col("price"), " grown in Peru</p>").alias("rendered")).alias("content"))


def captured_feeds(spark, sf_dir):
    """Payloads of all feed strategies."""
    rows = listed_parts(spark, sf_dir)
    doc = lambda products: F.struct(products.alias("products"))
    candidates = rows.withColumn("candidate_ord", F.explode(F.array(*[F.lit(i) for i in range(4)])))
    half = F.col("p_size") % 2
    candidates = candidates.where(
        F.col("candidate_ord").isin(1, 2) | ((F.col("candidate_ord") == 0) & (half == 0))
        | ((F.col("candidate_ord") == 3) & (half == 1)))
    return {
        "collection": as_payloads(rows, "collection", collection_product(), [], doc),
        "all_products": as_payloads(candidates, "all_products", collection_product(), ["candidate_ord"], doc),
        "woo": as_payloads(rows, "woo", woo_product(), ["page"]),
        "wordpress": as_payloads(rows, "wordpress", wordpress_product(), ["page"]),
    }


_SHOWN = ["strategy", "roaster", "bean_name", "source_url", "roast_profile", "price_aud", "process", "origin",
          "flavour_profile"]


@query("payload_products", f"""
WITH {_LISTED},
pairs AS (
  SELECT shop, p_partkey // 2 AS pair, min(p_partkey) AS p_partkey, bool_or(p_size % 3 <> 0) AS in_stock,
         bool_or(p_size % 2 = 1) AS esp, bool_or(p_size % 2 = 0) AS fil FROM paged GROUP BY 1, 2)
SELECT 'collection' AS strategy, 'shop ' || shop AS roaster, p_name || ' & ' || p_partkey AS bean_name,
       'https://s' || shop || '.example.com/products/p-' || p_partkey AS source_url, 'filter' AS roast_profile,
       price AS price_aud, term AS process, 'Lot ' || p_size || ', Kenya' AS origin, 'plum' AS flavour_profile
FROM listed WHERE p_size <> 2 AND p_size % 3 <> 0
UNION ALL
SELECT 'all_products', 'shop ' || shop, p_name || ' & ' || p_partkey,
       'https://s' || shop || '.example.com/products/p-' || p_partkey, 'filter', '1.00', term,
       'Lot ' || p_size || ', Kenya', 'plum'
FROM listed WHERE p_size <> 2 AND p_size % 3 <> 0
UNION ALL
SELECT 'woo', 'shop ' || g.shop, 'Pair ' || pair, 'https://s' || g.shop || '.example.com/shop/' || g.p_partkey,
       CASE WHEN esp AND fil THEN 'omni' WHEN esp THEN 'espresso' ELSE 'filter' END, price, term, '', ''
FROM pairs g JOIN paged p ON p.p_partkey = g.p_partkey WHERE in_stock
UNION ALL
SELECT 'wordpress', 'shop ' || shop, p_name || ' & ' || p_partkey,
       'https://s' || shop || '.example.com/product/' || p_partkey, 'espresso', price, '', 'Peru', ''
FROM paged WHERE p_size <> 2""")
def payload_products(spark, sf_dir):
    captured = captured_feeds(spark, sf_dir)
    sized = captured["collection"].withColumns({
        "price_variant_filter": F.lit("250g"), "skip_sources": F.lit(None).cast("array<string>"),
        "tag_aliases": F.lit(None).cast("map<string,array<string>>")})
    # choosing reads the products twice, so they are parsed once and written
    shop = written(feeds.collection_products(
        feeds.with_shops(captured["all_products"]), whole_shop=True), "all-products")
    best = select.best_of(shop, ["roaster"], "candidate_ord", "candidate_ord").drop("n_rows")
    products = (
        feeds.collection_products(sized)
        .unionByName(best)
        .unionByName(feeds.woo_products(feeds.with_shops(captured["woo"])))
        .unionByName(feeds.wordpress_products(feeds.with_shops(captured["wordpress"]))))
    return extract.items(products).select(*_SHOWN)


# the state of a shop's feed: 0 answers, 1 is refused, 2 is broken JSON, 3 is empty, 4 has
# nothing usable, 5 holds a document that is no list
_FEED_STATES = 6


@query("payload_reasons", f"""
WITH {_LISTED}, shops AS (SELECT DISTINCT shop, CAST(shop AS INT) AS n FROM listed),
candidates AS (
  SELECT shop, n, s.strategy, (n + k) % 6 AS state, c AS candidate
  FROM shops, (VALUES ('collection', 0, 0), ('all_products', 1, 3), ('woo', 2, 0), ('wordpress', 3, 0)) AS s(strategy, k, most), range(4) AS r(c)
  WHERE c <= most AND EXISTS (
    SELECT 1 FROM listed l WHERE l.shop = shops.shop AND (s.strategy <> 'all_products' OR c IN (1, 2) OR p_size % 2 = CAST(c = 3 AS INT)))),
single AS (
  SELECT shop, strategy, state, CASE strategy WHEN 'woo' THEN 'woocommerce' WHEN 'wordpress' THEN 'wp_product' ELSE 'shopify_json' END AS p
  FROM candidates WHERE strategy <> 'all_products'),
many AS (
  SELECT shop, state, string_agg('https://s' || shop || '.example.com:' || CASE state WHEN 1 THEN 'http_404' WHEN 2 THEN 'error'
                                 ELSE 'no_products' END, '; ') AS told
  FROM candidates WHERE strategy = 'all_products' GROUP BY 1, 2)
SELECT 'shop ' || shop AS roaster, strategy, CASE state
  WHEN 1 THEN p || '_http_404' WHEN 2 THEN p || '_error'
  WHEN 3 THEN CASE strategy WHEN 'wordpress' THEN p || '_no_items' ELSE p || '_no_products' END
  WHEN 5 THEN CASE strategy WHEN 'collection' THEN p || '_no_products' ELSE p || '_invalid_payload' END
  ELSE p || '_no_parsed_items' END AS reason
FROM single WHERE state > 0
UNION ALL SELECT 'shop ' || shop, 'all_products',
  CASE WHEN state <> 4 THEN 'shopify_all_json_failed: ' || told ELSE 'shopify_all_json_no_results' END
FROM many WHERE state > 0""")
def payload_reasons(spark, sf_dir):
    captured = captured_feeds(spark, sf_dir)
    everything = None
    for i, (strategy, payloads) in enumerate(captured.items()):
        state = (F.substring_index("roaster", " ", -1).cast("int") + i) % _FEED_STATES
        empty = "[]" if strategy in ("woo", "wordpress") else '{"products": []}'
        # of a feed of many pages the last one is broken or no list, the others are good
        last = F.col("page") == F.max("page").over(Window.partitionBy("roaster", "candidate_ord"))
        broken = payloads.withColumn("body", (
            F.when((state == 2) & last, "[not json").when(state == 3, empty)
            .when((state == 5) & last, '{"message": "none"}').otherwise(F.col("body")))).withColumn(
            "http_status", F.when(state == 1, 404).otherwise(200))
        everything = broken if everything is None else everything.unionByName(broken)
    number = F.substring_index("roaster", " ", -1).cast("int")
    place = F.array_position(F.array(*[F.lit(s) for s in captured]), F.col("strategy")) - 1
    items = everything.where((number + place) % _FEED_STATES == 0)
    return feeds.feed_reasons(everything, items).select("roaster", "strategy", "reason")


@query("config_join", """
WITH firsts AS (SELECT l_partkey AS p_partkey, min(l_suppkey) AS s_suppkey FROM lineitem GROUP BY 1)
SELECT p_partkey, s_name AS roaster, CASE WHEN s_suppkey % 2 = 0 THEN 'https://o.example.com/' || s_suppkey
       ELSE 'https://u.example.com/' || s_suppkey END AS listing_url, s_suppkey % 5 = 0 AS force_woo_api,
       CASE s_suppkey % 3 WHEN 0 THEN '' WHEN 1 THEN 'Lot ' || p_size || ', here' ELSE 'Hill ' || p_size || ', Peru' END AS origin
FROM part JOIN firsts USING (p_partkey) JOIN supplier USING (s_suppkey)""")
def config_join(spark, sf_dir):
    key = F.col("s_suppkey").cast("string")
    entry = F.struct(
        F.col("s_name").alias("name"), text_of(" https://u.example.com/", key).alias("url"),
        F.when(F.col("s_suppkey") % 2 == 0, text_of("https://o.example.com/", key, " ")).alias("collection_url_override"),
        F.when(F.col("s_suppkey") % 5 == 0, F.lit(True)).alias("force_woo_api"),
        F.struct(
            F.when(F.col("s_suppkey") % 3 == 0, F.array(F.lit("body"))).alias("skip_sources"),
            F.when(F.col("s_suppkey") % 3 == 1, F.create_map(F.lit("origin"), F.array(F.lit(" Region"))))
            .alias("tag_aliases")).alias("field_rules"))
    config = catalogue.parse_config(
        table(spark, sf_dir, "supplier").select(F.to_json(F.array(entry)).alias("value")))
    firsts = table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("p_partkey")).agg(
        F.min("l_suppkey").alias("s_suppkey"))
    owners = table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_name").alias("roaster"))
    rows = table(spark, sf_dir, "part").join(firsts, "p_partkey").join(owners, "s_suppkey").select(
        "p_partkey", "roaster", "p_size").join(config, "roaster")
    size = F.col("p_size").cast("string")
    raw = fields.raw_fields(
        F.array(text_of("REGION: Lot ", size, ", here")), text_of("Origin: Hill ", size, ", Peru"),
        F.col("skip_sources"), F.col("tag_aliases"))
    return rows.withColumn("raw", raw).select(
        "p_partkey", "roaster", "listing_url", "force_woo_api", origin_guard(F.col("raw.origin")).alias("origin"))


# --- pages ------------------------------------------------------------------------------

def part_pages(spark, sf_dir, *paths):
    """Every part as a captured product page, under each of the paths."""
    path = F.col("path")
    key, size = F.col("p_partkey"), F.col("p_size")
    price = F.col("p_retailprice").cast("decimal(10,2)").cast("string")
    head = choose(
        size, text_of('<meta content="', F.col("p_name"), ' &amp; co" property="og:title"/>'), F.lit(""), F.lit(""))
    heading = choose(size, F.lit("<h1>other</h1>"), text_of('<h1 class="t"><b>', F.col("p_name"), "</b> x</h1>"), F.lit(""))
    cost = choose(
        key,
        text_of('<meta property="product:price:amount" content="', price, '">'),
        text_of('<script type="application/ld+json">{"offers": {"price" : "', price, '"}}</script>'),
        # elements that nest their own tag 40 deep, and some that are never closed
        F.when(size % 2 == 0, text_of('<div class="cart">$0</div><p class="price main"><span>was</span> <b>$', price, "</b></p>")).otherwise(
            text_of('<i>$0</i><DIV class="price">', "<div>x</div><div>" * 40, "$", price, "</div >" * 40, "</div><div>$2</div>")),
        F.when(size % 2 == 0, text_of('<i>$1</i><span class="woocommerce-Price-amount"><bdi><span>$</span>', price, "</bdi></span>")).otherwise(
            text_of('<i>$1</i><span class="woocommerce-Price-amount"><span><bdi>$</span><span><span>', price)),
        text_of('<div class="the-price-box">$0</div><p>only $ ', price, " each</p>").alias("x"))
    html = text_of(
        "<!DOCTYPE html><html><head><title>", F.col("p_type"), "</title>", head, "<style>.price{}</style></head><body>",
        heading, "<!-- Process: Honey -->", cost, "<p>Process: ", pick(TERMS, size), "</p><p>Roast&nbsp;: espresso</p></body></html>")
    url = text_of("https://shop.example.com", path, F.when(size == 7, F.lit("gift-card-")).otherwise(F.lit("")),
                  key.cast("string"))
    # a page takes a thousand times the work that the size of its row suggests
    parts = spread(table(spark, sf_dir, "part")).withColumn("path", F.explode(F.array(*[F.lit(p) for p in paths or ("/products/",)])))
    return parts.select(
        key, size, url.alias("url"), F.when(size % 10 == 1, 404).otherwise(200).alias("http_status"),
        F.when(size % 10 == 0, "application/RSS+xml").otherwise("text/html").alias("content_type"), html.alias("html"))


_STATE = "CASE WHEN p_size % 10 = 1 THEN 'page' WHEN p_size % 10 = 0 THEN 'feed' WHEN p_size = 7 THEN 'blocked' ELSE 'html' END"
_TITLE = "CASE p_size % 3 WHEN 0 THEN p_name || ' & co' WHEN 1 THEN p_name || ' x' ELSE '' END"
_PRICE = "CAST(CAST(p_retailprice AS DECIMAL(10, 2)) AS VARCHAR)"
# '$0' in a price element is passed over; the last resort reads the page from its start
_CASES = f"""
cases AS (
  SELECT p_partkey, p_size, {_STATE} AS state, {_TITLE} AS title, {_TERM} AS term,
         CASE WHEN p_partkey % 5 = 4 THEN '0' ELSE {_PRICE} END AS price
  FROM part)
"""


@query("page_records", f"""
WITH {_CASES}
SELECT p_partkey, CASE WHEN state IN ('feed', 'blocked') THEN 'skip' WHEN state = 'html' AND title <> '' THEN 'ok' ELSE 'error' END AS status,
  CASE state WHEN 'page' THEN 'product_page_error: 404' WHEN 'feed' THEN 'non_product_feed_page' WHEN 'blocked' THEN 'excluded_non_beans'
       ELSE CASE WHEN title = '' THEN 'missing_product_title' ELSE '' END END AS error,
  CASE WHEN state IN ('html', 'blocked') THEN title ELSE '' END AS bean_name,
  CASE WHEN state IN ('html', 'blocked') THEN price ELSE '' END AS price_aud,
  CASE WHEN state = 'html' THEN term ELSE '' END AS process,
  CASE WHEN state = 'html' THEN 'espresso' ELSE '' END AS roast_profile,
  CASE WHEN state = 'page' THEN 'https://shop.example.com/list' ELSE 'https://shop.example.com/products/'
       || CASE WHEN p_size = 7 THEN 'gift-card-' ELSE '' END || p_partkey END AS source_url
FROM cases""")
def page_records(spark, sf_dir):
    rows = part_pages(spark, sf_dir).withColumnRenamed("url", "product_url").withColumns({
        "roaster": F.lit("a shop"), "listing_url": F.lit("https://shop.example.com/list"),
        "ord": F.col("p_partkey").cast("int")})
    return extract.items(pages.page_products(rows)).select(
        F.col("ord").cast("long").alias("p_partkey"), "status", "error", "bean_name", "price_aud", "process", "roast_profile", "source_url")


def part_listings(spark, sf_dir, path, escaped):
    """Listing pages of shops with 50 parts each; every part is linked twice."""
    key, size = F.col("p_partkey"), F.col("p_size")
    slug = text_of(F.when(size == 7, F.lit("gift-card-")).otherwise(F.lit("")), key.cast("string"))
    link = text_of('<a href="', path, slug, '?v=1">x</a><script>"https:\\/\\/shop.example.com', path.replace("/", "\\/"), slug, '"</script>')
    if not escaped:
        link = text_of('<a href="', path, slug, '">x</a><a data-url="', path, slug, '#y">y</a>')
    rows = table(spark, sf_dir, "part").groupBy(F.floor(key / 50).alias("n")).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(key, link.alias("a")))), lambda e: e.a), "")
        .alias("html"))
    return rows.select(
        text_of("shop ", F.col("n").cast("string")).alias("roaster"),
        text_of("https://shop.example.com/list/", F.col("n").cast("string")).alias("listing_url"),
        F.lit(200).alias("http_status"), text_of("<html>", F.col("html"), "</html>").alias("html"))


@query("link_driven_sources", f"""
WITH {_CASES}, strategies(strategy, path) AS (VALUES ('html_listing', '/products/'), ('shop_slug', '/shop/'), ('sitemap', '/products/')),
linked AS (
  SELECT *, 'shop ' || (p_partkey // 50) AS roaster, state = 'page' OR p_size % 10 = 2 AS lost,
         'https://shop.example.com' || CASE strategy WHEN 'sitemap' THEN '/' ELSE '/list/' || (p_partkey // 50) END AS listing
  FROM cases, strategies WHERE state NOT IN ('feed', 'blocked'))
SELECT strategy, roaster, CASE WHEN lost THEN listing ELSE 'https://shop.example.com' || path || p_partkey END AS source_url,
  CASE WHEN lost THEN '' ELSE title END AS bean_name, CASE WHEN lost THEN '' ELSE price END AS price_aud,
  CASE WHEN lost OR title = '' THEN 'error' ELSE 'ok' END AS status,
  CASE WHEN p_size % 10 = 2 THEN 'product_page_error: not captured' WHEN lost THEN 'product_page_error: 404'
       WHEN title = '' THEN 'missing_product_title' ELSE '' END AS error
FROM linked""")
def link_driven_sources(spark, sf_dir):
    return linked_items(spark, sf_dir).select("strategy", "roaster", "source_url", F.col("title").alias("bean_name"),
                                              F.col("price").alias("price_aud"), "status", "error")


def linked_items(spark, sf_dir):
    """The links of all three strategies, whose pages are read together."""
    links = []
    for strategy, path in (("html_listing", "/products/"), ("shop_slug", "/shop/")):
        listings = part_listings(spark, sf_dir, path, strategy == "shop_slug")
        links.append(pages.listing_links(listings, strategy).withColumn("strategy", F.lit(strategy)))
    found, _ = crawl.expand_sitemaps(*part_sitemaps(spark, sf_dir))
    links.append(pages.sitemap_links(found).select(
        F.col("site").alias("roaster"), F.lit("https://shop.example.com/").alias("listing_url"), "ord",
        F.col("url").alias("product_url"), F.lit("sitemap").alias("strategy")))
    links = written(functools.reduce(lambda a, b: a.unionByName(b), links), "links")
    captured = part_pages(spark, sf_dir, "/products/", "/shop/").where("p_size % 10 <> 2").drop("p_partkey", "p_size")
    return pages.not_skipped(written(pages.linked_products(links, captured), "products"))


@query("link_reasons", f"""
WITH {_CASES}, shops AS (SELECT DISTINCT p_partkey // 50 AS n FROM cases)
SELECT s.strategy, 'shop ' || n AS roaster, s.name || CASE n % 4 WHEN 1 THEN '_error' WHEN 2 THEN '_no_product_links' ELSE '_no_valid_products' END AS reason
FROM shops, (VALUES ('html_listing', 'listing_page'), ('shop_slug', 'shop_slug_listing')) AS s(strategy, name) WHERE n % 4 > 0
UNION ALL SELECT 'sitemap', 'shop ' || n, CASE n % 4 WHEN 1 THEN 'sitemap_no_product_urls'
  ELSE 'sitemap_no_valid_products: sitemap_http_404:https://shop.example.com/' || n || '/sm_1.xml' END
FROM shops WHERE n % 4 IN (1, 3)""")
def link_reasons(spark, sf_dir):
    # shops by number: 0 answers, 1 refuses its lists, 2 links nothing, 3 refuses its pages and a file
    shop = F.substring_index("roaster", " ", -1).cast("int") % 4
    refused = F.floor(F.col("p_partkey") / 50) % 4 == 3
    captured = part_pages(spark, sf_dir, "/products/", "/shop/").withColumn(
        "http_status", F.when(refused, 404).otherwise(F.col("http_status"))).drop("p_partkey", "p_size")
    docs, seeds = part_sitemaps(spark, sf_dir)
    number = F.regexp_extract("url", r"com/(\d+)/", 1).cast("int") % 4
    broken = ((number == 1) & F.col("url").endswith("sitemap.xml")) | ((number == 3) & F.col("url").endswith("sm_1.xml"))
    found, errors = crawl.expand_sitemaps(docs.withColumn("http_status", F.when(broken, 404).otherwise(200)), seeds)
    lists, links = {}, [pages.sitemap_links(found).select(
        F.col("site").alias("roaster"), F.lit("https://shop.example.com/").alias("listing_url"), "ord",
        F.col("url").alias("product_url"), F.lit("sitemap").alias("strategy"))]
    for strategy, path in (("html_listing", "/products/"), ("shop_slug", "/shop/")):
        lists[strategy] = part_listings(spark, sf_dir, path, strategy == "shop_slug").withColumns({
            "http_status": F.when(shop == 1, 500).otherwise(203), "html": F.when(shop == 2, "<p>none</p>").otherwise(F.col("html"))})
        links.append(pages.listing_links(lists[strategy], strategy).withColumn("strategy", F.lit(strategy)))
    links = written(functools.reduce(lambda a, b: a.unionByName(b), links), "links")
    items = written(pages.linked_products(links, captured), "products")
    told = pages.sitemap_reasons(seeds, errors, found, items.where("strategy = 'sitemap'")).withColumn("strategy", F.lit("sitemap"))
    for strategy, listings in lists.items():
        own = F.col("strategy") == strategy
        told = told.unionByName(pages.listing_reasons(listings, links.where(own), items.where(own), strategy).withColumn(
            "strategy", F.lit(strategy)))
    return told.select("strategy", "roaster", "reason")


def part_sitemaps(spark, sf_dir):
    """Per shop an index file that names two files (and itself), each with half the parts."""
    key = F.col("p_partkey")
    site = F.floor(key / 50).cast("string")
    slug = text_of(F.when(F.col("p_size") == 7, F.lit("gift-card-")).otherwise(F.lit("")), key.cast("string"))
    loc = text_of("<loc>https://shop.example.com/products/", slug, "</loc><loc>https://shop.example.com/about/", slug, "</loc>")
    halves = table(spark, sf_dir, "part").groupBy(site.alias("n"), (key % 2).alias("half")).agg(
        F.array_join(F.array_sort(F.collect_list(loc)), "").alias("body"))
    root = text_of("https://shop.example.com/", F.col("n"))
    index = halves.select("n").distinct().select(
        text_of(root, "/sitemap.xml").alias("url"),
        text_of("<LOC>", root, "/sm_0.xml</LOC><loc>", root, "/sitemap.xml</loc><loc>", root, "/sm_1.xml</loc>").alias("body"))
    files = halves.select(text_of(root, "/sm_", F.col("half").cast("string"), ".xml").alias("url"), "body")
    docs = index.unionByName(files).withColumn("http_status", F.lit(200))
    seeds = halves.select("n").distinct().select(
        text_of("shop ", F.col("n")).alias("site"), F.lit("https://shop.example.com/").alias("listing_url"),
        text_of(root, "/sitemap.xml").alias("url"), F.lit(0).alias("ord"))
    return docs, seeds


# --- prices and stock ----------------------------------------------------------------------

def order_variants(spark, sf_dir):
    """Order lines as variants of the order."""
    line = F.struct(
        F.col("l_linenumber").alias("n"), F.col("l_returnflag").alias("title"),
        F.col("l_extendedprice").cast("decimal(12,2)").cast("string").alias("price"),
        F.when(F.col("l_linestatus") == "O", F.lit(True)).otherwise(F.lit(False)).alias("available"))
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(
        F.array_sort(F.collect_list(line)).alias("variants"))


@query("variant_price", """
SELECT l_orderkey, CAST(CAST(coalesce(min(l_extendedprice) FILTER (WHERE l_returnflag = 'R'), min(l_extendedprice))
       AS DECIMAL(12, 2)) AS VARCHAR) AS price_aud
FROM lineitem GROUP BY l_orderkey HAVING bool_or(l_linestatus = 'O')""")
def variant_price(spark, sf_dir):
    orders = order_variants(spark, sf_dir).where(~prices.sold_out(F.col("variants")))
    return orders.select(
        "l_orderkey", prices.variant_price(F.col("variants"), F.lit("r")).alias("price_aud"))


@query("detail_price_override", """
WITH lines AS (
  SELECT l_orderkey, min(l_extendedprice) AS low, arg_min(l_returnflag, (l_linenumber, l_returnflag, l_extendedprice)) AS first_flag
  FROM lineitem GROUP BY 1)
SELECT o_orderkey, CAST(CAST(CASE WHEN first_flag = 'N' AND o_orderkey % 4 <> 0 THEN low ELSE o_totalprice END
       AS DECIMAL(12, 2)) AS VARCHAR) AS price_aud
FROM orders LEFT JOIN lines ON l_orderkey = o_orderkey""")
def detail_price_override(spark, sf_dir):
    line = F.struct(
        F.col("l_linenumber").alias("n"), F.col("l_returnflag").alias("flag"), F.col("l_extendedprice").alias("amount"))
    grouped = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(
        F.array_sort(F.collect_list(line)).alias("lines"))
    variants = F.transform("lines", lambda e: F.struct(
        F.lit("").alias("title"), e.amount.cast("decimal(12,2)").cast("string").alias("price"),
        F.when(e.flag == "N", "AUD").otherwise("USD").alias("price_currency"),
        F.lit(None).cast("string").alias("inventory_management"), F.lit("deny").alias("inventory_policy"),
        F.lit(0).alias("inventory_quantity")))
    details = grouped.select(
        F.lit("shop").alias("roaster"), F.col("l_orderkey").cast("string").alias("handle"),
        F.when(F.col("l_orderkey") % 4 == 0, 404).otherwise(200).alias("http_status"),
        F.to_json(F.struct(F.struct(variants.alias("variants")).alias("product"))).alias("body"))
    rows = table(spark, sf_dir, "orders").select(
        "o_orderkey", F.lit("shop").alias("roaster"), F.col("o_orderkey").cast("string").alias("handle"),
        F.lit(None).cast("string").alias("price_variant_filter"),
        F.col("o_totalprice").cast("decimal(12,2)").cast("string").alias("price"))
    return feeds.with_details(rows, details).select("o_orderkey", F.col("price").alias("price_aud"))


@query("inventory_filter", """
SELECT l_orderkey, count(*) AS n_variants FROM lineitem GROUP BY l_orderkey
HAVING NOT bool_and(l_returnflag <> 'N' AND l_linestatus = 'F' AND l_quantity <= 25)""")
def inventory_filter(spark, sf_dir):
    line = F.struct(
        F.when(F.col("l_returnflag") != "N", "shopify").alias("inventory_management"),
        F.when(F.col("l_linestatus") == "F", "deny").otherwise("continue").alias("inventory_policy"),
        F.when(F.col("l_quantity") != 25, (F.col("l_quantity") - 25).cast("int")).alias("inventory_quantity"))
    orders = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_list(line).alias("variants"))
    return orders.where(~prices.out_of_stock(F.col("variants"))).select(
        "l_orderkey", F.size("variants").cast("long").alias("n_variants"))


@query("minor_unit_price", """
WITH cents AS (SELECT o_orderkey, o_orderkey % 8 AS way, CAST(round(o_totalprice * 100) AS BIGINT) AS c FROM orders)
SELECT o_orderkey, CASE way WHEN 0 THEN '' WHEN 4 THEN '' WHEN 1 THEN CAST(CAST(c / 100.0 AS DECIMAL(18, 2)) AS VARCHAR)
  WHEN 2 THEN CAST(CAST(c AS DECIMAL(18, 2)) AS VARCHAR) WHEN 3 THEN CAST(CAST(c * 10 / 1000.0 AS DECIMAL(18, 2)) AS VARCHAR)
  WHEN 5 THEN '0.00' WHEN 6 THEN c || '000.00' ELSE CAST(CAST(c // 100 AS DECIMAL(18, 2)) AS VARCHAR) END AS price_aud
FROM cents""")
def minor_unit_price(spark, sf_dir):
    cents = F.round(F.col("o_totalprice") * 100).cast("long").cast("string")
    way = F.col("o_orderkey") % 8
    # among them the greatest and least units there are, and more digits than a number has
    raw = (
        F.when(way == 0, F.concat(F.lit("-"), cents)).when(way == 3, F.concat(cents, F.lit("0 ")))
        .when(way == 7, F.concat(F.floor(cents.cast("long") / 100).cast("string"), F.lit("0" * 20))).otherwise(cents))
    minor = (
        F.when(way == 2, F.lit(0)).when(way == 3, F.lit(3)).when(way == 4, F.lit(-2147483648)).when(way == 5, F.lit(2147483647))
        .when(way == 6, F.lit(-3)).when(way == 7, F.lit(20)))
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", prices.minor_unit_price(raw, minor).alias("price_aud"))


@query("title_grouping", """
WITH products AS (
  SELECT l_suppkey AS shop, p_name AS title, l_orderkey * 10 + l_linenumber AS ord, l_partkey, p_type, l_linestatus
  FROM lineitem JOIN part ON p_partkey = l_partkey)
SELECT 'shop ' || shop AS roaster, title AS bean_name, count(*) AS n_products, min((ord, l_partkey))[2] AS first_part,
       bool_or(p_type = 'SMALL') AS espresso_seen, bool_or(p_type = 'LARGE') AS filter_seen
FROM products GROUP BY shop, title HAVING bool_or(l_linestatus = 'O')""")
def title_grouping(spark, sf_dir):
    from shelf.operators.grouping import title_groups

    products = table(spark, sf_dir, "lineitem").join(
        table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey")).select(
        text_of("shop ", F.col("l_suppkey").cast("string")).alias("roaster"), F.col("p_name").alias("bean_name"),
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ord"), F.col("l_partkey").alias("first_part"),
        F.when(F.col("l_linestatus") == "F", F.lit(False)).alias("is_in_stock"),
        F.array(F.when(F.col("p_type") == "SMALL", "For Espresso").when(F.col("p_type") == "LARGE", "FILTER")).alias("categories"))
    groups = title_groups(
        products, ["roaster", "bean_name"], F.struct("ord", "first_part"), F.struct("first_part"),
        F.col("is_in_stock"), F.col("categories"))
    return groups.select(
        "roaster", "bean_name", "n_products", "first.first_part", "espresso_seen", "filter_seen")
