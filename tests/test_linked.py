"""Links of several strategies, and the sitemap source as one run."""

from pyspark.sql import functions as F

from shelf.plans import collect
from shelf.sources import feeds, pages

PAGE = "url string, http_status int, content_type string, html string"


def shops(spark, rows):
    config = spark.createDataFrame(rows, "roaster string, listing_url string")
    return config.withColumns({"price_variant_filter": F.lit(None).cast("string"), "skip_sources": F.lit(None).cast("array<string>"),
                               "tag_aliases": F.lit(None).cast("map<string,array<string>>")})


def test_pages_are_read_once(spark, tmp_path):
    html = "<h1>Bean</h1><p class='price'>$5</p>"
    spark.createDataFrame([("https://s.com/products/1", 200, "text/html", html)], PAGE).write.parquet(str(tmp_path / "pages"))
    captured = spark.read.parquet(str(tmp_path / "pages"))
    links = spark.createDataFrame(
        [(r, s, "https://s.com/list", i, f"https://s.com/products/{i}") for r in "ab" for s in ("html_listing", "shop_slug", "sitemap") for i in (1, 2)],
        "roaster string, strategy string, listing_url string, ord long, product_url string")
    found = pages.linked_products(feeds.with_shops(links), captured)
    rows = [tuple(r) for r in found.select("roaster", "strategy", "ord", "title", "price", "error").collect()]
    assert len(rows) == 12 and {r[3:] for r in rows if r[2] == 1} == {("Bean", "5", "")}
    assert {r[5] for r in rows if r[2] == 2} == {"product_page_error: not captured"}
    plan = found._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1]
    assert plan.count("FileScan parquet") == 1 and plan.count("html#") > 0


def test_sitemaps_of_both_hosts(spark):
    config = shops(spark, [("a", "https://a.com/list"), ("b", "https://www.b.com/list"), ("c", "https://c.com/x"), ("d", None)])
    loc = lambda *urls: "".join(f"<loc>{u}</loc>" for u in urls)
    documents = spark.createDataFrame([
        ("https://a.com/robots.txt", 200, "Sitemap: https://a.com/own.xml\nSITEMAP: https://a.com/sitemap.xml"),
        ("https://a.com/own.xml", 200, loc("https://a.com/products/2", "https://a.com/products/1", "https://a.com/product/feed/x")),
        ("https://a.com/sitemap.xml", 200, loc("https://a.com/products/1", "https://other.com/products/9")),
        ("https://b.com/wp-sitemap.xml", 200, loc("https://b.com/shop/1")),
        ("https://c.com/sitemap.xml", 500, None)], "url string, http_status int, body string")
    captured = spark.createDataFrame([(f"https://{u}", s, "text/html", "<h1>x</h1>") for u, s in (
        ("a.com/products/1", 200), ("a.com/products/2", 200), ("b.com/shop/1", 404))], PAGE)
    products, reasons = collect.sitemap_source(config, documents, captured)
    got = sorted((r.roaster, r.candidate_ord, r.product_url, r.status) for r in products.collect())
    assert got == [("a", 0, "https://a.com/products/1", "ok"), ("a", 0, "https://a.com/products/2", "ok"), ("b", 100, "https://b.com/shop/1", "error")]
    # the usual places come first, so product 1 is found before product 2
    order = {r.product_url: r.ord for r in products.where("roaster = 'a'").collect()}
    assert order["https://a.com/products/1"] < order["https://a.com/products/2"]
    told = {(r.roaster, r.candidate_ord): r.reason for r in reasons.collect()}
    assert told[("b", 0)] == told[("a", 100)] == told[("c", 0)] == "sitemap_no_product_urls"
    assert told[("b", 100)].startswith("sitemap_no_valid_products: sitemap_error:https://b.com/sitemap.xml")
    items = collect.collect(config, pages.not_skipped(products), reasons)
    failed = {r.roaster: r.error for r in items.where("status = 'error'").collect()}
    assert failed["c"].startswith("https://c.com/x => sitemap_no_product_urls || https://www.c.com/x =>")
    assert failed["d"] == "missing_url"


def test_discovered_handles(spark):
    listings = spark.createDataFrame([
        ("a", "https://a.com", 0, 200, "/collections/tea /collections/single-origin /collections/coffee-beans /collections/all /collections/Tea"),
        ("b", "https://b.com", 0, 404, "/collections/tea"), ("c", "https://c.com", 0, 200, None), ("d", "https://d.com", 0, None, "x")],
        "roaster string, listing_url string, candidate_ord int, http_status int, html string")
    got = {(r.rank, r.handle) for r in pages.discovered_handles(listings).collect()}
    assert got == {(1, "coffee-beans"), (2, "single-origin"), (3, "tea")}
    assert {r.roaster: r.reason for r in pages.discovery_reasons(listings).collect()} == {
        "b": "handle_discovery_error", "c": "handle_discovery_no_candidates", "d": "handle_discovery_error"}


def test_reasons_of_empty_and_missing_feeds(spark):
    rows = [("s", "all_products", c, 1, "https://s.com/l", f"https://s.com/{c}", s, "j", b) for c, s, b in (
        (0, 200, '{"products": []}'), (1, 404, None), (2, None, None), (3, 200, "{}"))]
    rows += [("t", "all_products", 0, 1, "u", "https://t.com/0", 200, "j", '{"products": [{"title": ""}]}'),
             ("u", "woo", 0, 1, "u", "https://u.com", None, "j", None),
             ("v", "discovered_collection", 0, 1, "u", "https://v.com/collections/tea/products.json?limit=250", 200, "j", '{"products": []}')]
    payloads = spark.createDataFrame(rows, "roaster string, strategy string, candidate_ord int, page int, listing_url string, url string, "
                                           "http_status int, content_type string, body string")
    got = {r.roaster: r.reason for r in feeds.feed_reasons(payloads, payloads.limit(0)).collect()}
    assert got == {
        "s": "shopify_all_json_failed: https://s.com/0:no_products; https://s.com/1:http_404; https://s.com/2:error; https://s.com/3:no_products",
        "t": "shopify_all_json_no_results", "u": "woocommerce_error", "v": "tea:shopify_json_no_products"}


def planned(df, phase="optimizedPlan"):
    return getattr(df._jdf.queryExecution(), phase)().toString().split("== Initial Plan ==")[-1]


def test_prices_are_looked_for_once(spark):
    page = spark.createDataFrame([("<p class=price>$5</p>", "$7")], "html string, text string")
    price = planned(page.select(pages.page_price(F.col("html"), F.col("text")).alias("price")))
    # one search of the page, and one of what it found for what follows the start tag
    assert price.count("woocommerce-Price-amount(?:") == 4  # in either kind of quotes
    assert price.count("product:price:amount") == 1


def test_odd_names_of_elements(spark):
    cases = {
        '<a\\E(b class="price"><a\\E(b>x</a\\E(b>$5</a\\E(b>$9': "5", '<a.c class="price"><abc></abc>$6</a.c>$9': "6",
        '<a<b class="price">x</a<b>$7': "7", '<p class="price"></p>$8': "8", '<A class="price">x</a<b>$1': "1",
        '<p class="price">$0</p><b class="price-x">$0</b>': "0"}
    rows = spark.createDataFrame(list(cases), "string")
    assert {r.value: r.p for r in rows.select("value", pages.page_price(F.col("value"), F.col("value")).alias("p")).collect()} == cases


def test_pages_of_a_small_file_are_dealt_out(spark, sf_dir):
    from shelf.plans.feeds import part_pages

    assert part_pages(spark, sf_dir).rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism


def stored(df, folder):
    """Read from files, whose size Spark knows."""
    df.write.parquet(str(folder))
    return df.sparkSession.read.parquet(str(folder))


def test_no_page_goes_to_the_driver(spark, tmp_path):
    captured = spark.createDataFrame([("https://s.com/products/1", 200, "text/html", "<h1>Bean</h1>")], PAGE)
    links = spark.createDataFrame([("a", "sitemap", "https://s.com/list", 0, "https://s.com/products/1")],
                                  "roaster string, strategy string, listing_url string, ord long, product_url string")
    found = pages.linked_products(feeds.with_shops(stored(links, tmp_path / "links")), stored(captured, tmp_path / "pages"))
    assert "Broadcast" not in planned(found, "executedPlan")


def test_no_sitemap_goes_to_the_driver(spark, tmp_path):
    from shelf.operators import crawl

    docs = spark.createDataFrame([("https://a.com/sitemap.xml", 404, "x" * 9)], "url string, http_status int, body string")
    seeds = spark.createDataFrame([("a", "https://a.com/", "https://a.com/sitemap.xml", 0)], "site string, listing_url string, url string, ord int")
    _, errors = crawl.expand_sitemaps(stored(docs, tmp_path / "docs"), seeds)
    assert "Broadcast" not in planned(errors, "executedPlan") and errors.first().error.startswith("sitemap_http_404")
