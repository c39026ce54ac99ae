"""Small hand-made cases: edge rows, whole runs and the shape of plans."""

import json
import random

from pyspark.sql import functions as F

from shelf.functions import prices, roast, text, urls
from shelf.operators import cooldown as cooling
from shelf.operators import crawl, diff, publish, select
from shelf.plans import collect
from shelf.sources import catalogue, pages


def test_clean_text_decodes_before_it_strips(spark):
    rows = [("&lt;b&gt;x&lt;/b&gt; &eacute;&nbsp; y",), (None,), ("a&amp;lt;b",), ("&copy &#x41;",)]
    df = spark.createDataFrame(rows, "t string")
    got = [r[0] for r in df.select(text.clean_text(F.col("t"))).collect()]
    assert got == ["x é y", "", "a&lt;b", "© A"]
    assert [r[0] for r in df.select(text.strip_html(F.col("t"))).collect()][2] == "a&amp;lt;b"


def test_key_text(spark):
    df = spark.createDataFrame([("Café – X",), ("CAFÉ ‑  x",), ("a⁻b",)], "t string")
    got = [r[0] for r in df.select(text.key_text(F.col("t"))).collect()]
    # NFKC turns a superscript minus into a sign that is no dash of the list
    assert got == ["café - x", "café - x", "a−b"]


def test_resolve(spark):
    base = "https://www.A.com/shop/list?x=1"
    cases = [("b", "https://www.A.com/shop/b"), ("../c?d", "https://www.A.com/c?d"), ("//h/i", "https://h/i"),
             ("?q", "https://www.A.com/shop/list?q"), ("", base), ("/a/./b/../c", "https://www.A.com/a/c"),
             ("mailto:x", "mailto:x"), ("../../../z", "https://www.A.com/z")]
    df = spark.createDataFrame([(base, r, w) for r, w in cases], "base string, ref string, want string")
    got = df.select("want", urls.resolve(urls.base_parts(F.col("base")), F.col("ref")).alias("got")).collect()
    assert [r.got for r in got] == [r.want for r in got]


def test_variant_prices(spark):
    schema = "v array<struct<title:string,price:string,available:boolean>>"
    rows = [([("250g", "21.5", False), ("1kg", "9", None)],), ([("1kg", "9", False)],), ([("x", "abc", True)],),
            ([],), (None,), ([("250G", None, False)],)]
    df = spark.createDataFrame(rows, schema)
    got = df.select(prices.variant_price(F.col("v"), F.lit("250g")).alias("p"), prices.sold_out(F.col("v")).alias("s")).collect()
    assert [r.p for r in got] == ["21.50", "9.00", "abc", "", "", ""]
    assert [r.s for r in got] == [False, True, False, False, False, True]


def test_tag_roast_overrides(spark):
    tags = ["Brew Method.Espresso", "Coffee Type.Filter", "Coffee Type.Other"]
    df = spark.createDataFrame([(tags,)], "t array<string>")
    assert df.select(roast.tag_roasts(F.col("t"))).first()[0] == ["filter"]


def test_returning_item_is_new_again(spark):
    df = spark.createDataFrame([("1", "a"), ("2", "b"), ("3", "a"), ("3", "b")], "snap string, key string")
    got = {(r.snap, r.key): r.is_new for r in diff.arrivals_by_snapshot(df, ["key"], "snap").collect()}
    assert got == {("1", "a"): True, ("2", "b"): True, ("3", "a"): True, ("3", "b"): False}


def test_error_rows_of_the_previous_snapshot_count(spark):
    columns = ["roaster", "bean_name", "source_url", "product_url", "roast_profile", "origin", "price_aud",
               "process", "varietal", "flavour_profile", "status"]
    row = lambda bean, status: ("R", bean, "", "p", "", "", "", "", "", "", status)
    latest = spark.createDataFrame([row("a", "ok"), row("b", "ok"), row("c", "error")], columns)
    previous = spark.createDataFrame([row("A ", "error")], columns)
    got = publish.published_items(latest, previous).select("bean_name", "is_new", "url").collect()
    assert sorted(tuple(r) for r in got) == [("a", False, "p"), ("b", True, "p")]


def test_cooldown_against_brute_force(spark):
    rng = random.Random(7)
    rows, number = [], 0
    for key in range(5):
        t = 0
        for _ in range(400 if key else 3000):      # one key holds most of the rows
            t += rng.choice([0, 1, 5, 30, 59, 60, 61, 400])
            rows.append((key, number, t))
            number += 1
    want = set()
    for key in range(5):
        last = None
        for k, i, t in sorted((r for r in rows if r[0] == key), key=lambda r: (r[2], r[1])):
            if last is None or t >= last + 60:
                want.add(i)
                last = t
    df = spark.createDataFrame(rows, "k int, i int, t int").select("k", "i", F.timestamp_seconds("t").alias("ts"))
    for spans in (1, 3, 1440):
        got = {r.i for r in cooling.cooldown(df, "k", "ts", "i", 60, span_gaps=spans).collect()}
        assert got == want


def test_shop_list_and_missing_address(spark, tmp_path):
    shops = [{"name": "A", "url": " https://a.com/collections/x "}, {"url": "", "force_woo_api": True,
             "field_rules": {"skip_sources": ["body"], "tag_aliases": {"origin": ["Region"]}}}]
    (tmp_path / "shops.json").write_text(json.dumps(shops))
    config = catalogue.read_config(spark, str(tmp_path / "shops.json"))
    rows = {r.roaster: r for r in config.collect()}
    assert rows["A"].listing_url == "https://a.com/collections/x"
    assert rows["Unknown"].tag_aliases == {"origin": ["Region"]}
    failed = catalogue.shops_without_address(config).collect()
    assert [(r.roaster, r.error) for r in failed] == [("Unknown", "missing_url")]


def test_snapshots_and_diary_are_read(spark, tmp_path):
    for name, beans in (("list_2026-01-01_000000.json", ["a"]), ("list_2026-01-08_000000.json", ["a", "b"])):
        items = [{"roaster": "R", "bean_name": b, "status": "ok"} for b in beans]
        (tmp_path / name).write_text(json.dumps({"generated_at": name[5:-5], "items": items}, indent=1))
    df = catalogue.read_snapshots(spark, str(tmp_path / "list_*.json"))
    newest = select.newest(df, "snapshot", 1)
    assert sorted(r.bean_name for r in newest.collect()) == ["a", "b"]
    entry = {"slug": "s", "bean_name": {"zh": "豆", "en": ""}, "roaster": "Plain", "tags": ["t", {"en": "u"}]}
    (tmp_path / "diary.json").write_text(json.dumps({"entries": [entry]}))
    row = catalogue.read_diary(spark, str(tmp_path / "diary.json")).first()
    assert row.roaster == {"en": "Plain", "zh": "Plain"} and row.tags[1] == {"en": "u"}


def test_sitemap_expansion_is_bounded_and_ends(spark):
    docs = spark.createDataFrame([
        ("i", 200, "<loc>i</loc><loc>a.xml</loc><loc>b.xml</loc>"),
        ("a.xml", 200, "<loc>https://s.com/products/1</loc><loc>https://o.com/products/2</loc>"),
        ("b.xml", 404, None),
    ], "url string, http_status int, body string").replace("i", "https://s.com/sitemap.xml", "url")
    seeds = spark.createDataFrame(
        [("s", "https://s.com", "https://s.com/sitemap.xml", 0)], "site string, listing_url string, url string, ord int")
    docs = docs.withColumn("body", F.replace("body", F.lit("<loc>i<"), F.lit("<loc>https://s.com/sitemap.xml<")))
    found, errors = crawl.expand_sitemaps(docs, seeds)
    assert [r.url for r in found.collect()] == ["https://s.com/products/1"]
    assert [r.error for r in errors.collect()] == ["sitemap_http_404:b.xml"]
    found, _ = crawl.expand_sitemaps(docs, seeds, max_files=1)
    assert found.count() == 0


def test_nested_price_elements(spark):
    html = ('<div class="x price-list">n</div><p class="price"><span><span>&#36;</span>12.50</span></p>'
            '<span class="woocommerce-Price-amount">$9</span>')
    df = spark.createDataFrame([(html,), ("<p>only $ 7.5 now</p>",)], "h string")
    got = df.select(pages.page_price(F.col("h"), text.plain_text(F.col("h"))))
    assert [r[0] for r in got.collect()] == ["12.50", "7.5"]


def test_first_source_with_products_wins(spark):
    rows = [("s", "woo", 0), ("s", "html_listing", 100), ("t", "all_products", 1), ("t", "all_products", 2),
            ("t", "all_products", 2), ("t", "wordpress", 0)]
    df = spark.createDataFrame(rows, "roaster string, strategy string, candidate_ord int")
    got = {tuple(r) for r in collect.chosen_source(df).select("roaster", "strategy", "candidate_ord").collect()}
    assert got == {("s", "woo", 0), ("t", "all_products", 2)}


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_filters_and_columns_reach_the_scan(spark, sf_dir):
    from shelf.operators.browse import facet_filter

    items = spark.read.parquet(f"{sf_dir}/part.parquet").withColumnRenamed("p_brand", "roaster")
    plan = _plan(facet_filter(items, roaster="Brand#3").select("p_name"))
    assert "EqualTo(p_brand,Brand#3)" in plan and "p_retailprice" not in plan


def test_top_per_group_limits_before_the_shuffle(spark, sf_dir):
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id", "event_id", "value")
    plan = _plan(select.top_per_group(events, ["user_id"], [F.desc("value")], 3))
    assert plan.count("WindowGroupLimit") == 2


def test_one_per_key_reduces_before_the_shuffle(spark, sf_dir):
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id", "event_id", "ts")
    assert "partial_max_by" in _plan(select.last_per_key(events, ["user_id"], F.col("ts")))


def test_collection_run_over_links_and_sitemaps(spark):
    from shelf import schemas

    config = catalogue.parse_config(spark.createDataFrame([(json.dumps([
        {"name": "L", "url": "https://l.com/list"}, {"name": "M", "url": "https://m.com/"},
        {"name": "W", "url": "https://w.com/", "force_woo_api": True},
        {"name": "E", "url": "https://e.com/"}]),)], "value string"))
    payloads = spark.createDataFrame([
        ("E", "woo", 0, 1, "https://e.com/", "https://e.com/x", 500, "", ""),
    ], schemas.PAYLOAD)
    listing = '<a href="/products/one">1</a><a href="/products/gift-card">2</a><a href="/products/gone">3</a>'
    listings = spark.createDataFrame([
        ("L", "html_listing", 0, "https://l.com/list", 200, "text/html", listing),
        ("W", "html_listing", 0, "https://w.com/", 200, "text/html", listing),
    ], "roaster string, strategy string, candidate_ord int, listing_url string, http_status int, "
       "content_type string, html string")
    page = "<h1>{}</h1><p>Origin: Huila, Colombia Process: Washed</p><b class='price'>$9.50</b>"
    captured = spark.createDataFrame([
        ("https://l.com/products/one", 200, "text/html", page.format("One")),
        ("https://m.com/products/two", 200, "text/html", page.format("Two espresso")),
    ], "url string, http_status int, content_type string, html string")
    found = spark.createDataFrame(
        [("M", "https://m.com/", "https://m.com/products/two", 0, 0)],
        "site string, listing_url string, url string, ord int, pos int")
    products = collect.source_products(config, payloads, None, listings, captured, found)
    reasons = spark.createDataFrame(
        [("E", 0, "https://e.com/", "woo", "woocommerce_http_500")],
        "roaster string, candidate_ord int, listing_url string, strategy string, reason string")
    rows = collect.collect(config, products, reasons).select(
        "roaster", "bean_name", "origin", "process", "price_aud", "status", "error").collect()
    assert sorted(tuple(r) for r in rows) == [
        ("E", "", "", "", "", "error", "https://e.com/ => woocommerce_http_500"),
        ("L", "", "", "", "", "error", "product_page_error: not captured"),
        ("L", "One", "Huila, Colombia", "Washed", "9.50", "ok", ""),
        ("M", "Two espresso", "Huila, Colombia", "Washed", "9.50", "ok", ""),
        ("W", "", "", "", "", "error", "unknown_scrape_error"),
    ]


def test_listings_are_read_unless_their_status_is_an_error(spark):
    html = '<a href="/products/one">1</a>'
    rows = [(str(status), f"https://{status}.com/", status, html) for status in (200, 203, 206, 404, 500)] + [("none", "https://n.com/", None, html)]
    listings = spark.createDataFrame(rows, "roaster string, listing_url string, http_status int, html string")
    links = pages.listing_links(listings, "html_listing")
    assert {r.roaster for r in links.collect()} == {"200", "203", "206"}
    items = links.select("roaster", F.lit("ok").alias("status"))
    reasons = pages.listing_reasons(listings, links, items, "html_listing").collect()
    assert {tuple(r) for r in reasons} == {(x, "listing_page_error") for x in ("404", "500", "none")}
