"""Inputs beyond limits that the library once had, and inputs that once ended a job."""

import json

import pytest
from pyspark.sql import functions as F

from shelf.functions import localised, prices, urls
from shelf.functions.fields import origin_from_text, with_fields
from shelf.operators import browse, crawl, merge
from shelf.sources import feeds, pages


def one(spark, column, *values):
    return spark.range(1).select(column.alias("x")).first().x


def test_all_pages_count(spark):
    def body(page, n):
        return json.dumps([{"title": {"rendered": f"Bean {page} {i}"}, "link": f"https://s.example.com/p/{page}/{i}",
                            "excerpt": {"rendered": ""}, "content": {"rendered": "x"}} for i in range(n)])

    sizes = {1: 150, 2: 3, 6: 100, 9: 1}
    rows = [("a", "wordpress", 0, p, "https://s.example.com", "u", 200, body(p, n)) for p, n in sizes.items()]
    rows += [("a", "wordpress", 0, 4, "https://s.example.com", "u", 500, None)]
    rows += [("b", "wordpress", 0, 1, "https://s.example.com", "u", 200, body(1, 2)), ("b", "wordpress", 0, 7, "l", "u", 200, "{}")]
    captured = spark.createDataFrame(rows, "roaster string, strategy string, candidate_ord int, page int, listing_url string, url string, http_status int, body string")
    got = feeds.wordpress_products(feeds.with_shops(captured))
    assert {r.roaster: r["count"] for r in got.groupBy("roaster").count().collect()} == {"a": 254}
    assert got.select("ord").distinct().count() == 254
    stopped = feeds.wordpress_products(feeds.with_shops(captured), pages=5, size=100)
    assert stopped.count() == 153 + 2
    reasons = {r.roaster: r.reason for r in feeds.feed_reasons(captured, got).collect()}
    assert reasons == {"b": "wp_product_invalid_payload"}


def test_sitemaps_have_no_limit(spark):
    files = [(f"https://s.example.com/sm_{i}.xml", 200, f"<loc>https://s.example.com/products/{i}</loc>") for i in range(30)]
    index = "".join(f"<loc>{u}</loc>" for u, _, _ in files) + "".join(f"<loc>https://s.example.com/products/x{i}</loc>" for i in range(400))
    docs = spark.createDataFrame([("https://s.example.com/sitemap.xml", 200, index), *files], "url string, http_status int, body string")
    robots = spark.createDataFrame([("s", "https://s.example.com/", 200, "User-agent: *\nSitemap: https://s.example.com/sitemap.xml\n")],
                                   "site string, listing_url string, http_status int, body string")
    found, _ = crawl.expand_sitemaps(docs, crawl.robots_seeds(robots))
    assert pages.sitemap_links(found).count() == 430


def test_reach_goes_on(spark):
    edges = spark.createDataFrame([(str(i), str(i + 1)) for i in range(8)], "src string, dst string")
    seeds = spark.createDataFrame([("0",)], "node string")
    assert crawl.reach(edges, seeds).count() == 9 and crawl.reach(edges, seeds, 3).count() == 4


def test_levels_join_where_they_lie(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        with crawl.Bucketed(spark, 4) as tables:
            links = tables.append(spark.createDataFrame([("a", "b"), ("b", "c")], "src string, dst string"), "edges", "src")
            seen = tables.append(spark.createDataFrame([("a", 0)], "node string, depth int"), "seen", "node")
            seen = tables.append(spark.createDataFrame([("b", 1)], "node string, depth int"), "seen", "node")
            found = crawl.found_from(links, seen, 2)
            assert [tuple(r) for r in found.collect()] == [("c", 2)]
            plan = found._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1]
            # the one exchange is that of the nodes found
            assert plan.count("Exchange hashpartitioning") == 1 and plan.count("SortMergeJoin") == 2
            assert "EqualTo(depth,1)" in plan
            names = list(tables.names.values())
        assert not any(spark.catalog.tableExists(n) for n in names)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_reach_of_odd_rows(spark):
    edges = spark.createDataFrame([("a", "a"), ("a", None), (None, "z"), ("a", "b"), ("a", "b"), ("b", "a")], "src string, dst string")
    seeds = spark.createDataFrame([("a",), ("a",), (None,), ("x",)], "node string")
    assert {tuple(r) for r in crawl.reach(edges, seeds).collect()} == {("a", 0), ("x", 0), ("b", 1)}
    assert crawl.reach(edges, seeds.limit(0)).count() == 0


@pytest.mark.parametrize("deep", [1, 4, 9, 40])
def test_nested_price(spark, deep):
    html = f'<p>$1</p><div class="price">{"<div>" * deep}$12.50{"</div>" * deep}</div><div>$3</div>'
    assert one(spark, pages.page_price(F.lit(html), F.lit("$1"))) == "12.50"


def test_element_ends(spark):
    cases = {
        '<div class="price"><div>no</div></div><p>$3</p>': "3",  # it ends before the amount; the page is read
        '<div class="price"><div>no</div><p>$4</p>': "4",  # never closed
        "<span class='price'><span-x>$5</span-x></span>$9": "5",  # another name that begins alike
        '<div class="price">' + "<div>" * 300 + "</div>" * 300 + "</div><b class=price-b>x</b>$7": "7",
        '<img class="price"><b class="x price">$8</b>': "8",
        '<div class="price"></span></p>$6</div>$1': "6",
        '<div\nclass="price"\n>$6</DIV\n>$1': "6"}
    for html, want in cases.items():
        first = one(spark, pages.page_price(F.lit(html), F.lit(html)))
        assert first == want, html[:60]


def test_long_values_are_kept(spark):
    land = "Colombia " + "Huila " * 40
    row = spark.createDataFrame([(f"Origin: {land}; Process: Washed", "", ["PROCESS: x"])], "text string, body string, tags array<string>")
    assert len(row.select(origin_from_text(F.col("text")).alias("o")).first().o) > 200
    got = with_fields(row, text="text", body="text", tags="tags").first()
    assert got.origin == "" and got.refused["origin"].startswith("Colombia")


def test_localised_kinds(spark):
    values = {'"The \\"Best\\""': {"en": 'The "Best"', "zh": 'The "Best"'}, '"{braces"': {"en": "{braces", "zh": "{braces"},
              '{"en": "a", "zh": "b"}': {"en": "a", "zh": "b"}, "null": None, "[1]": None}
    for text, want in values.items():
        assert one(spark, localised.localised(F.parse_json(F.lit(text)))) == want


@pytest.mark.parametrize("raw,minor,want", [
    ("1" * 31, 2, "1" * 29 + ".11"), ("12345", 13, "0.00"), ("5", -1, "50.00"), ("1999", None, "19.99"), ("12345", 3, "12.35"),
    ("9" * 60, 0, "9" * 60 + ".00"), ("-5", 2, ""), ("", 2, ""), ("995", 3, "1.00")])
def test_minor_units(spark, raw, minor, want):
    assert one(spark, prices.minor_unit_price(F.lit(raw), F.lit(minor).cast("int"))) == want


def test_long_variant_price(spark):
    rows = spark.createDataFrame([([("", "9" * 20 + ".5")],)], "v array<struct<title string, price string>>")
    assert rows.select(prices.variant_price(F.col("v"), F.lit(None).cast("string")).alias("x")).first().x == "9" * 20 + ".50"


def test_links(spark):
    html = '<a href=/products/one>x</a><a href="/products/tw&#111;">y</a><a class=b href=\'/products/three&#x65;&quot;\'>z</a>'
    found = one(spark, urls.product_links(F.lit("https://s.example.com/list"), F.lit(html)))
    assert found[:2] == ["https://s.example.com/products/one", "https://s.example.com/products/two"] and len(found) == 3


def test_entities_in_links(spark):
    html = ('<a href="/products/caf&#8217;e">x</a><a href="/products/a&eacute;b">y</a><a href="/products/c&amp;eacute;d">z</a>'
            '<a href="/products/one?a=1&copy=2">q</a>')
    found = one(spark, urls.product_links(F.lit("https://s.example.com/list"), F.lit(html)))
    assert found == ["https://s.example.com/products/caf’e", "https://s.example.com/products/aéb",
                     "https://s.example.com/products/c&eacute", "https://s.example.com/products/one"]
    body = "<loc> https://s.com/products/a&eacute;b </loc><LOC>https://s.com/p?a=1&amp;b=2</LOC><loc>https://s.com/<b>x</b></loc>"
    assert one(spark, crawl.sitemap_locs(F.lit(body))) == ["https://s.com/products/aéb", "https://s.com/p?a=1&b=2", "https://s.com/ x"]


@pytest.mark.parametrize("raw,unit,want", [
    ("1234", None, "12.34"), ("1234", 2147483647, "0.00"), ("1234", -2147483648, ""), ("5", 3, "0.01"), ("4", 3, "0.00"), ("5", 1, "0.50"),
    ("0", 0, "0.00"), ("9" * 30, 29, "10.00"), ("9" * 18, 18, "1.00"), ("7", -3, "7000.00"), ("1" * 50, 48, "11.11"), ("", 2, ""), ("-1", 2, ""),
    ("007", 2, "0.07"), ("999", 5, "0.01"), ("4999", 6, "0.00"), ("1", 19, "0.00"), (" 12 ", 0, "12.00")])
def test_minor_units(spark, raw, unit, want):
    assert one(spark, prices.minor_unit_price(F.lit(raw), F.lit(unit).cast("int"))) == want


def test_document_rules(spark):
    code = F.lit("0" * 32)
    for body, want in (('{"items":{"a":{}}} trailing', "bad_json"), ('{"items":{"a":1},"items":{"a":{}}}', None), ('{"items":{"a":1}}', "bad_shape"),
                       ("{'items':{}}", "bad_json"), ('{"items":{"a":{}},"tombstones":{},"tombstones":{"k":"1"}}', "bad_shape"),
                       ('{"items":{},"items":{"a":{}},"tombstones":null}', "bad_shape"), ('{"items":{"a":"{"},"items":{"a":"{b"}}', "bad_shape"),
                       ('{"items":{"a":1},"items":{"a":{}},"tombstones":{"k":1e400}}', "bad_shape"), ("null", "bad_shape"), ("", "bad_json"),
                       ('{"items":{"a":{},"a":{}}}', None), ("{}] [{}", "bad_json"), ('{"items":{}', "bad_json")):
        assert one(spark, merge.reject_reason(code, F.lit(body))) == want, body
    assert one(spark, merge.reject_reason(code, F.lit('{"items":{"a":{"t":"\U0001f600"}}}'), 25)) == "too_large"


def test_query_needs_a_text(spark):
    with pytest.raises(ValueError):
        browse.facet_filter(spark.range(1), query="x")


def test_cleanup(spark):
    from shelf import session

    before, session._FOLDERS[:] = session._FOLDERS[:], []
    table = session.written(spark.range(3), "t")
    folder = session._FOLDERS[0]
    assert table.count() == 3
    session.cleanup(spark)
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    assert not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)
    session._FOLDERS[:] = before
