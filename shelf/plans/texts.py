"""Queries: text clean-up, block rules, links and addresses."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelf import vocabulary as V
from shelf.functions import rules, text, urls
from shelf.operators import crawl, phrases, select
from shelf.plans.registry import query, table
from shelf.session import spread
from shelf.sources.pages import with_page_title
from shelf.vocabulary import BLOCKED_PATTERNS, BLOCKED_PHRASES

_MATCH = "trim(regexp_replace(lower({}), '[^a-z0-9]+', ' ', 'g'))"


@query("match_normalise", f"SELECT doc_id, {_MATCH.format('text')} AS match_text FROM documents")
def match_normalise(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(
        "doc_id", text.match_text(F.col("text")).alias("match_text"))


# phrases that do occur in the sample texts, besides the standing list
_PHRASES = [*BLOCKED_PHRASES, "of the", "de la", "und der", "red ring", "hot gear"]


def _sql_blocked(match: str) -> str:
    """One bounded search per phrase, and the patterns as they are listed."""
    tests = [f"contains(m, ' {p} ')" for p in _PHRASES]
    tests += [f"regexp_matches(m, '{p}')" for p in BLOCKED_PATTERNS]
    return f"(SELECT {' OR '.join(tests)} FROM (SELECT ' ' || {match} || ' ' AS m))"


@query("phrase_exclusion", f"""
SELECT 'document' AS kind, doc_id AS id,
       {_sql_blocked(_MATCH.format('text'))} AS blocked FROM documents
UNION ALL
SELECT 'part', p_partkey, {_sql_blocked(_MATCH.format("p_name || ' ' || p_type"))} FROM part""")
def phrase_exclusion(spark, sf_dir):
    documents = table(spark, sf_dir, "documents").select(
        F.lit("document").alias("kind"), F.col("doc_id").alias("id"), "text")
    parts = table(spark, sf_dir, "part").select(
        F.lit("part"), "p_partkey", F.concat_ws(" ", "p_name", "p_type"))
    pattern = rules.phrase_pattern(_PHRASES, BLOCKED_PATTERNS)
    return documents.union(parts).select(
        "kind", "id", rules.is_blocked(F.col("text"), pattern).alias("blocked"))


# a list of tens of thousands: the standing one, what texts begin with, and names with a number
_NUMBERS = 25
_LISTED = f"""
texts AS (
  SELECT 'document' AS kind, doc_id AS id, {_MATCH.format('text')} AS m FROM documents
  UNION ALL SELECT 'part', p_partkey, {_MATCH.format("p_name || ' ' || p_type")} FROM part),
listed AS (
  SELECT DISTINCT phrase FROM (
    SELECT unnest([{', '.join(repr(p) for p in _PHRASES)}]) AS phrase
    UNION ALL SELECT array_to_string(string_split(m, ' ')[1:3], ' ') FROM texts WHERE kind = 'document'
    UNION ALL SELECT p_name || ' ' || k FROM part, range(1, {_NUMBERS + 1}) r(k)) WHERE phrase <> ''),
words AS (SELECT kind, id, string_split(m, ' ') AS w FROM texts),
grams AS (
  SELECT DISTINCT kind, id, array_to_string(w[i:i + n - 1], ' ') AS phrase
  FROM (SELECT kind, id, w, unnest(range(1, len(w) + 1)) AS i FROM words), range(1, 7) s(n) WHERE i + n - 1 <= len(w)),
hits AS (SELECT kind, id, count(*) AS n_phrases, min(phrase) AS first_phrase FROM grams SEMI JOIN listed USING (phrase) GROUP BY 1, 2)"""


def listed_texts(spark, sf_dir):
    """The texts, and a list of tens of thousands of phrases made of the tables."""
    documents = table(spark, sf_dir, "documents")
    part = spread(table(spark, sf_dir, "part"))
    texts = documents.select(F.lit("document").alias("kind"), F.col("doc_id").alias("id"), "text").union(
        part.select(F.lit("part"), "p_partkey", F.concat_ws(" ", "p_name", "p_type")))
    standing = spark.range(1).select(F.explode(F.array(*[F.lit(p) for p in _PHRASES])).alias("phrase"))
    begins = documents.select(F.array_join(F.slice(F.split(text.match_text(F.col("text")), " "), 1, 3), " "))
    numbered = part.select("p_name", F.explode(F.sequence(F.lit(1), F.lit(_NUMBERS))).alias("k")).select(
        F.concat_ws(" ", "p_name", F.col("k").cast("string")))
    return texts, standing.union(begins).union(numbered)


@query("phrase_dictionary", f"WITH {_LISTED} SELECT kind, id, n_phrases, first_phrase FROM hits")
def phrase_dictionary(spark, sf_dir):
    texts, listed = listed_texts(spark, sf_dir)
    hits = phrases.phrase_hits(texts, listed, ["kind", "id"])
    return hits.groupBy("kind", "id").agg(F.count(F.lit(1)).alias("n_phrases"), F.min("phrase").alias("first_phrase"))


@query("phrase_dictionary_exclusion", f"""
WITH {_LISTED}
SELECT kind, id, hits.id IS NOT NULL OR {' OR '.join(f"regexp_matches(m, '{p}')" for p in BLOCKED_PATTERNS)} AS blocked
FROM texts LEFT JOIN hits USING (kind, id)""")
def phrase_dictionary_exclusion(spark, sf_dir):
    texts, listed = listed_texts(spark, sf_dir)
    return phrases.with_blocked(texts, listed, ["kind", "id"], patterns=BLOCKED_PATTERNS)


@query("entity_exclusion", """
SELECT p_partkey, p_brand, p_name FROM part
WHERE NOT (p_brand = 'Brand#3' AND regexp_matches(p_name, '\\b(ring|bolt)\\b')) AND lower(p_brand) <> 'brand#7'""")
def entity_exclusion(spark, sf_dir):
    from shelf.operators.publish import without_shops
    from shelf.plans.views import HIDDEN_SHOP

    parts = table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_name")
    kept = parts.where(~rules.is_blocked_for(
        F.col("p_brand"), F.col("p_name"), shop_patterns={"brand#3": [r"\bring\b", r"\bbolt\b"]}))
    return without_shops(kept.withColumn("roaster", F.col("p_brand")), (HIDDEN_SHOP,)).drop("roaster")


_VISIBLE = "html"
for _p, _r in (
    ("(?s)<!--.*?-->", " "), ("(?is)<script[^>]*>.*?</script\\s*>", " "),
    ("(?is)<style[^>]*>.*?</style\\s*>", " "), ("<[!?/A-Za-z][^>]*>", " "),
):
    _VISIBLE = f"regexp_replace({_VISIBLE}, '{_p}', '{_r}', 'g')"
for _e, _c in (("&copy;", "©"), ("&middot;", "·"), ("&quot;", '"'), ("&amp;", "&")):
    _VISIBLE = f"replace({_VISIBLE}, '{_e}', '{_c}')"
_SQUEEZE = "trim(regexp_replace({}, '\\s+', ' ', 'g'))"


@query("page_text", f"""
SELECT page_id, {_SQUEEZE.format(_VISIBLE)} AS page_text,
       {_SQUEEZE.format("regexp_replace(html, '<[^>]+>', ' ', 'g')")} AS tagless
FROM pages""")
def page_text(spark, sf_dir):
    pages = text.with_page_text(table(spark, sf_dir, "pages"), page_text=F.col("html"))
    return pages.select("page_id", "page_text", text.strip_html(F.col("html")).alias("tagless"))


_H1 = "regexp_extract(html, '(?is)<h1[^>]*>(.*?)</h1>', 1)"


@query("page_title", f"""
SELECT page_id, {_SQUEEZE.format(
    "replace(replace(" + _H1 + ", '&quot;', '\"'), '&amp;', '&')")} AS title FROM pages""")
def page_title(spark, sf_dir):
    return with_page_title(table(spark, sf_dir, "pages"), F.col("html")).select("page_id", "title")


_LINKS = """
WITH hrefs AS (
  SELECT page_id, url, unnest(regexp_extract_all(html, '<a href="([^"]*)"', 1)) AS href,
         generate_subscripts(regexp_extract_all(html, '<a href="([^"]*)"', 1), 1) AS n
  FROM pages),
absolute AS (
  SELECT page_id, regexp_extract(url, '^(https?://[^/]+)', 1) || href AS link, min(n) AS n
  FROM hrefs GROUP BY 1, 2)
"""


@query("page_links", _LINKS + """
SELECT page_id, CAST(row_number() OVER (PARTITION BY page_id ORDER BY n) - 1 AS INT) AS ord, link FROM absolute""")
def page_links(spark, sf_dir):
    links = urls.product_links(F.col("url"), F.col("html"), markers=("/",))
    return text.unnest(table(spark, sf_dir, "pages"), links, "ord", "link", "page_id")


@query("same_site_links", _LINKS + """
SELECT page_id, count(*) AS n_links FROM absolute
WHERE (page_id % 3 = 0 OR page_id % 3 = 2 AND NOT contains(link, '//www.')) AND length(link) % 4 <> 0 GROUP BY page_id""")
def same_site_links(spark, sf_dir):
    # links are moved to a 'www.' host, to another site, below a product path or a feed
    links = urls.product_links(F.col("url"), F.col("html"), markers=("/",))
    rows = text.unnest(table(spark, sf_dir, "pages"), links, "ord", "link", "page_id", "url")
    host = F.upper(urls.url_authority(F.col("url")))
    moved = F.when(F.col("page_id") % 3 == 1, F.concat(F.lit("cdn."), host)).when(
        F.col("page_id") % 3 == 2, F.concat(F.lit("www."), F.lower(host))).otherwise(host)
    place = F.when(F.length("link") % 4 == 0, "/products/FEED").when(
        F.length("link") % 4 == 1, "/Shop").otherwise("/a/product")
    full = F.concat(F.lit("https://"), moved, place, urls.url_path(F.col("link")), F.lit("?a=/feed"))
    return rows.where(crawl.is_site_product(F.col("url"), full)).groupBy("page_id").agg(
        F.count("*").alias("n_links"))


@query("sitemap_locs", """
WITH locs AS (
  SELECT page_id, unnest([url, url || '/sitemap_1', regexp_extract(url, '^https?://[^/]+') || '/shop/' || page_id || '?a=1&b=2']) AS loc,
         unnest([0, 1, 2]) AS ord
  FROM pages)
SELECT page_id, ord, loc, contains(lower(loc), 'sitemap') AS is_file, contains(loc, '/shop/') AS is_product,
       (SELECT 'https://r.example.com/' || p.page_id || '.xml' FROM pages p WHERE p.page_id = locs.page_id) AS robots
FROM locs""")
def sitemap_locs(spark, sf_dir):
    root = urls.site_root(F.col("url"))
    body = F.concat(
        F.lit("<urlset>\n<url><loc> "), "url", F.lit("\n</loc></url><url><LOC>"), "url",
        F.lit("/sitemap_1</LOC></url><url><loc>"), root, F.lit("/shop/"), F.col("page_id").cast("string"),
        F.lit("?a=1&amp;b=2</loc></url></urlset>"))
    robots = F.concat(
        F.lit("User-agent: *\r\nDisallow: /cart\n sitemap:  https://r.example.com/"),
        F.col("page_id").cast("string"), F.lit(".xml \nSitemap: two words\n"))
    rows = text.unnest(
        table(spark, sf_dir, "pages"), crawl.sitemap_locs(body), "ord", "loc",
        "page_id", "url", F.array_join(crawl.robots_sitemaps(robots), " ").alias("robots"))
    return rows.select(
        "page_id", "ord", "loc", crawl.is_sitemap(F.col("loc")).alias("is_file"),
        crawl.is_site_product(F.col("url"), F.col("loc")).alias("is_product"), "robots")


@query("handle_ranking", """
WITH handles AS (
  SELECT p_brand AS roaster, p_partkey * 4 AS ord, replace(p_name, ' ', '-') AS handle FROM part
  UNION ALL
  SELECT p_brand, p_partkey * 4 + 1, CASE p_size % 4 WHEN 0 THEN 'coffee-' WHEN 1 THEN 'single-' WHEN 2 THEN 'shop-bean-'
         ELSE '' END || lower(p_type) FROM part),
firsts AS (
  SELECT roaster, handle, min(ord) AS ord,
         CASE WHEN contains(handle, 'coffee') THEN 5 ELSE 0 END + CASE WHEN contains(handle, 'single') THEN 3 ELSE 0 END
         + CASE WHEN contains(handle, 'bean') THEN 2 ELSE 0 END + CASE WHEN contains(handle, 'shop') THEN 1 ELSE 0 END AS score
  FROM handles GROUP BY 1, 2),
ranked AS (SELECT *, row_number() OVER (PARTITION BY roaster ORDER BY score DESC, length(handle), ord) AS place FROM firsts)
SELECT roaster, handle, score, CAST(place AS INT) AS place FROM ranked WHERE place <= 6""")
def handle_ranking(spark, sf_dir):
    kind = F.element_at(
        F.array(*[F.lit(x) for x in ("coffee-", "single-", "shop-bean-", "")]), (F.col("p_size") % 4 + 1).cast("int"))
    html = F.concat(
        F.lit('<a href="/collections/'), F.translate("p_name", " ", "-"), F.lit('">x</a><a href="/collections/'),
        kind, F.upper("p_type"), F.lit('-?page=2">y</a><a href="/collections/all">'),
        F.lit('</a><a href="/collections/frontpage/z">'))
    found = text.unnest(
        table(spark, sf_dir, "part"), urls.collection_handles(html), "pos", "handle",
        F.col("p_brand").alias("roaster"), "p_partkey")
    firsts = found.groupBy("roaster", "handle").agg(F.min(F.struct("p_partkey", "pos")).alias("at"))
    scored = firsts.withColumn("score", urls.handle_score(F.col("handle")))
    order = [F.desc("score"), F.length("handle"), F.col("at")]
    return select.top_per_group(scored, ["roaster"], order, V.HANDLE_LIMIT, rank="place").drop("at")


@query("shop_slug_links", """
WITH parts AS (SELECT p_partkey, replace(p_name, ' ', '-') AS slug, lower(p_type) AS kind FROM part)
SELECT p_partkey, 0 AS ord, 'https://www.shop.example.com/shop/' || slug AS link FROM parts
UNION ALL SELECT p_partkey, 1, 'https://www.shop.example.com/shop/' || kind || '/' || slug FROM parts
UNION ALL SELECT p_partkey, 2, 'https://www.shop.example.com/shop/' || slug || '-' || p_partkey FROM parts""")
def shop_slug_links(spark, sf_dir):
    slug, kind = F.translate("p_name", " ", "-"), F.lower("p_type")
    html = F.concat(
        F.lit('<a href="../about.html">p</a><a href="/shop/'), slug, F.lit('/?x=1">a</a><script>{"u":"https:\\/\\/shop.example.com\\/shop\\/'),
        kind, F.lit("\\/"), slug, F.lit('","v":"\\u002Fshop\\u002fcart"}</script><a href="https://other.example.com/shop/'), slug,
        F.lit('">o</a><a href="/shop/tag/'), slug, F.lit('">t</a><a href="'), slug, F.lit("-"),
        F.col("p_partkey").cast("string"), F.lit('">r</a><a href="/shop/a/b/c">deep</a>'))
    base = F.lit("https://www.shop.example.com/shop/")
    return text.unnest(spread(table(spark, sf_dir, "part")), urls.shop_links(base, html), "ord", "link", "p_partkey")


@query("fetch_plan", """
WITH parts AS (
  SELECT page_id, regexp_extract(url, '^(https?)://([^/]+)', 1) AS scheme,
         regexp_extract(url, '^(https?)://([^/]+)', 2) AS host FROM pages),
roots AS (
  SELECT page_id, 0 AS host_ord, scheme || '://' || host AS root FROM parts
  UNION ALL SELECT page_id, 1, scheme || '://' || CASE WHEN starts_with(host, 'www.') THEN substr(host, 5)
    ELSE 'www.' || host END FROM parts),
lists AS (
  SELECT page_id, host_ord, root,
    ['/collections/c' || page_id || '/products.json?limit=250&country=AU', '/collections/c' || page_id || '/x?y=1',
     '/products.json?limit=250&country=AU', '/collections/all/products.json?limit=250&country=AU',
     '/collections/shop/products.json?limit=250&country=AU', '/collections/coffee/products.json?limit=250&country=AU',
     '/sitemap.xml', '/sitemap_index.xml', '/wp-sitemap.xml', '/product-sitemap.xml', '/product-sitemap1.xml',
     '/product-sitemap2.xml', '/wp-json/wc/store/v1/products', '/wp-json/wp/v2/product'] AS paths,
    ['collection', 'html_listing', 'all_products', 'all_products', 'all_products', 'all_products', 'sitemap', 'sitemap',
     'sitemap', 'sitemap', 'sitemap', 'sitemap', 'woo', 'wordpress'] AS kinds
  FROM roots)
SELECT page_id, host_ord, CAST(i - 1 AS INT) AS ord, kinds[i] AS strategy, root || paths[i] AS url
FROM lists, range(1, 15) AS t(i)""")
def fetch_plan(spark, sf_dir):
    listing = F.concat(
        urls.site_root(F.col("url")), F.lit("/collections/c"), F.col("page_id").cast("string"), F.lit("/x?y=1"))
    hosts = table(spark, sf_dir, "pages").select("page_id", listing.alias("listing")).select(
        "page_id", F.posexplode(F.array("listing", urls.other_www(F.col("listing")))).alias("host_ord", "listing"))
    rows = hosts.select(
        "page_id", "host_ord", F.posexplode(urls.fetch_candidates(F.col("listing"))).alias("ord", "c"))
    return rows.select("page_id", "host_ord", "ord", "c.strategy", "c.url")
