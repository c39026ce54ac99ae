"""Queries: diary entries, search, months, levels, facet filters."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelf.functions import localised as L
from shelf.operators import browse, search
from shelf.plans.arrivals import _PUBLISHED, published
from shelf.plans.extraction import choose, text_of
from shelf.plans.registry import query, table
from shelf.operators.publish import PUBLISHED
from shelf.sources import catalogue


@query("facet_search", _PUBLISHED + """
SELECT roaster, bean_name, url, roast_profile, '' AS origin, price_aud, '' AS process, p_type AS varietal,
       p_name AS flavour_profile, key NOT IN (SELECT key FROM before) AS is_new
FROM shown WHERE roast_profile = 'espresso' AND key NOT IN (SELECT key FROM before)
  AND contains(lower(roaster || ' ' || bean_name || ' ' || p_name), 'brand#1')""")
def facet_search(spark, sf_dir):
    items = published(spark, sf_dir)
    found = browse.facet_filter(
        items, roast="espresso", new_only=True, query=" Brand#1 ",
        search=L.search_text("roaster", "bean_name", "flavour_profile"))
    return found.orderBy("roaster", "bean_name", "ord").select(*PUBLISHED)


@query("shop_groups", _PUBLISHED + """
SELECT roaster, count(*) AS n_items, count(*) FILTER (WHERE key NOT IN (SELECT key FROM before)) AS n_new
FROM shown GROUP BY roaster""")
def shop_groups(spark, sf_dir):
    return browse.facet_filter(published(spark, sf_dir)).groupBy("roaster").agg(
        F.count("*").alias("n_items"), F.count_if("is_new").alias("n_new"))


def order_entries(spark, sf_dir):
    """Orders as dated entries; some have no date."""
    return table(spark, sf_dir, "orders").select(
        F.when(F.col("o_orderkey") % 50 == 0, F.lit("")).otherwise(
            F.date_format("o_orderdate", "yyyy-MM-dd")).alias("date"),
        F.col("o_orderkey").alias("ord"), F.col("o_totalprice"),
        F.when(F.col("o_orderpriority") == "1-URGENT", "filter").otherwise("omni").alias("roast_profile"))


_ENTRIES = """
WITH entries AS (
  SELECT CASE WHEN o_orderkey % 50 = 0 THEN '' ELSE strftime(o_orderdate, '%Y-%m-%d') END AS date, o_orderkey AS ord, o_totalprice,
         CASE WHEN o_orderpriority = '1-URGENT' THEN 'filter' ELSE 'omni' END AS roast_profile FROM orders)
"""


@query("month_groups", _ENTRIES + """
SELECT substr(date, 1, 7) AS month, count(*) AS n_entries, max(date) AS last_date, min(date) AS first_date,
       CASE WHEN date[1:7] = '' THEN '—' ELSE strftime(CAST(max(date) AS DATE), '%B %Y') END AS label,
       CASE WHEN date[1:7] = '' THEN '—' ELSE strftime(CAST(max(date) AS DATE), '%Y年%-m月') END AS label_zh
FROM entries GROUP BY date[1:7], substr(date, 1, 7)""")
def month_groups(spark, sf_dir):
    return browse.month_groups(order_entries(spark, sf_dir)).withColumns({
        "label": L.month_label(F.col("month")), "label_zh": L.month_label(F.col("month"), "zh")})


@query("diary_order", _ENTRIES + """
SELECT date, ord, coalesce(strftime(TRY_CAST(date AS DATE), '%-d %B %Y'), date) AS long_date FROM entries
ORDER BY date DESC, ord""")
def diary_order(spark, sf_dir):
    return browse.in_diary_order(order_entries(spark, sf_dir)).select("date", "ord", L.long_date(F.col("date")).alias("long_date"))


@query("diary_facets", _ENTRIES + """
SELECT 'month' AS facet, ord FROM entries WHERE starts_with(date, '1995-03') AND roast_profile = 'filter'
UNION ALL SELECT 'no month', ord FROM entries WHERE date = ''
UNION ALL SELECT 'roaster', ord FROM (SELECT *, 'shop ' || ord % 9 AS roaster FROM entries) WHERE roaster = 'shop 4'
UNION ALL SELECT 'all', ord FROM entries""")
def diary_facets(spark, sf_dir):
    entries = order_entries(spark, sf_dir).withColumn("roaster", text_of("shop ", (F.col("ord") % 9).cast("string")))
    facets = {"month": {"month": "1995-03", "roast": "filter"}, "no month": {"month": ""}, "roaster": {"roaster": "shop 4"}, "all": {}}
    parts = [browse.facet_filter(entries, **given).select(F.lit(name).alias("facet"), "ord") for name, given in facets.items()]
    return functools.reduce(DataFrame.unionByName, parts)


@query("month_timeline", _ENTRIES + """
SELECT substr(date, 1, 7) AS month, bool_or(o_totalprice > 495000 AND roast_profile = 'filter') AS live,
       strftime(CAST(max(date) AS DATE), '%b %Y') AS label
FROM entries WHERE date <> '' GROUP BY 1""")
def month_timeline(spark, sf_dir):
    entries = order_entries(spark, sf_dir)
    found = browse.facet_filter(entries, roast="filter").where("o_totalprice > 495000")
    return browse.month_timeline(entries, found).withColumn(
        "label", L.month_label(F.col("month"), short=True))


@query("localised_text", """
SELECT doc_id, text AS own, CASE WHEN lang IN ('en', 'es') THEN text ELSE '' END AS chinese,
       CASE WHEN lang IN ('en', 'es') THEN text ELSE '' END AS english FROM documents""")
def localised_text(spark, sf_dir):
    # a text in its own language; Spanish ones are plain strings, which serve any language
    plain = F.try_variant_get(F.parse_json(F.to_json(F.struct("text"))), "$.text", "variant")
    value = F.when(F.col("lang") == "es", L.localised(plain)).otherwise(F.create_map("lang", "text"))
    return table(spark, sf_dir, "documents").select("doc_id", value.alias("v"), "lang").select(
        "doc_id", L.in_language(F.col("v"), F.col("lang")).alias("own"),
        L.in_language(F.col("v"), "zh").alias("chinese"), L.in_language(F.col("v"), "en").alias("english"))


@query("diary_search", """
SELECT doc_id, source FROM documents
WHERE contains(lower('X' || source || ' ' || text || ' ' || lang || ' Label ' || lang), 'the of')
   OR contains(lower('X' || source || ' ' || text || ' ' || lang || ' Label ' || lang), 'de label de')""")
def diary_search(spark, sf_dir):
    rows = searched(spark, sf_dir).withColumn("search", browse.diary_search_text())
    found = F.contains("search", F.lit("the of")) | F.contains("search", F.lit("de label de"))
    return rows.where(found).select("doc_id", "source")


def searched(spark, sf_dir):
    """Documents as bilingual entries."""
    return table(spark, sf_dir, "documents").select(
        "doc_id", "source", F.create_map(F.lit("zh"), text_of("X", F.col("source")), F.lit("en"), F.lit("")).alias("bean_name"),
        F.create_map(F.lit("en"), "text").alias("roaster"), F.array(F.create_map(F.lit("en"), "lang")).alias("tags"),
        F.array(F.struct(F.lit("i").alias("icon"), F.create_map(
            F.lit("en"), "lang", F.lit("zh"), F.lit("Label")).alias("label"))).alias("flavours"))


# what is searched for: pieces of every twentieth text, some of them short, in any case
_TERMS = r"""
terms AS (
  SELECT DISTINCT lower(regexp_replace(t, '^\s+|\s+$', '', 'g')) AS term FROM (
    SELECT ' ' || upper(substr(text, 5, 14)) || ' ' AS t FROM documents WHERE doc_id % 20 = 0
    UNION ALL SELECT substr(text, 3, 2) FROM documents WHERE doc_id % 20 = 0
    UNION ALL SELECT 'nowhere to be found ' || doc_id FROM documents WHERE doc_id % 20 = 0) WHERE regexp_matches(t, '\S'))"""


@query("search_index", f"""
WITH {_TERMS},
texts AS (SELECT doc_id, lower('X' || source || ' ' || text || ' ' || lang || ' Label ' || lang) AS h FROM documents)
SELECT term, count(*) AS n_found, min(doc_id) AS first_id, sum(doc_id) AS ids FROM terms JOIN texts ON contains(h, term) GROUP BY 1""")
def search_index(spark, sf_dir):
    index = search.TrigramIndex.build(searched(spark, sf_dir), browse.diary_search_text(), "doc_id")
    some = table(spark, sf_dir, "documents").where("doc_id % 20 = 0")
    terms = some.select(F.explode(F.array(
        F.concat(F.lit(" "), F.upper(F.substring("text", 5, 14)), F.lit(" ")), F.substring("text", 3, 2),
        F.concat(F.lit("nowhere to be found "), "doc_id"))).alias("term"))
    return index.search_all(terms).groupBy("term").agg(
        F.count(F.lit(1)).alias("n_found"), F.min("id").alias("first_id"), F.sum("id").alias("ids"))


_LEVELS = "['low', 'medium', 'high', 'odd', NULL]"


@query("ordinal_levels", f"""
WITH levels AS (
  SELECT p_partkey, 0 AS ord, 'acidity' AS dim, {_LEVELS}[p_size % 5 + 1] AS level FROM part
  UNION ALL SELECT p_partkey, 1, 'sweetness', {_LEVELS}[p_partkey % 5 + 1] FROM part
  UNION ALL SELECT p_partkey, 4, 'aftertaste', 'high' FROM part)
SELECT p_partkey, ord, dim, level, CASE level WHEN 'medium' THEN 50 WHEN 'high' THEN 100 ELSE 0 END AS percent
FROM levels WHERE level IS NOT NULL""")
def ordinal_levels(spark, sf_dir):
    level = lambda n: choose(n, F.lit("low"), F.lit("medium"), F.lit("high"), F.lit("odd"), F.lit(None))
    profile = F.struct(
        level(F.col("p_size")).alias("acidity"), level(F.col("p_partkey")).alias("sweetness"),
        F.lit(None).cast("string").alias("body"), F.lit("").alias("aroma"), F.lit("high").alias("aftertaste"))
    rows = table(spark, sf_dir, "part").select("p_partkey", profile.alias("profile"))
    return rows.select("p_partkey", F.inline(L.level_rows(F.col("profile"))))


@query("cover_and_chips", """
WITH lines AS (
  SELECT l_orderkey, list(l_returnflag || l_partkey ORDER BY l_linenumber, l_returnflag || l_partkey) AS all_images FROM lineitem GROUP BY 1)
SELECT l_orderkey, CASE WHEN l_orderkey % 2 = 0 THEN all_images[1] WHEN l_orderkey % 3 = 0 THEN 'one' END AS cover,
       array_to_string(all_images[1:3], ' ') AS chips,
       CAST(CASE WHEN l_orderkey % 2 = 0 THEN len(all_images) WHEN l_orderkey % 3 = 0 THEN 1 ELSE 0 END AS INT) AS n_images
FROM lines""")
def cover_and_chips(spark, sf_dir):
    label = F.concat("l_returnflag", F.col("l_partkey").cast("string"))
    orders = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(
        F.array_sort(F.collect_list(F.struct("l_linenumber", label.alias("x")))).alias("lines"))
    flavours = F.transform("lines", lambda e: e.x)
    images = F.when(F.col("l_orderkey") % 2 == 0, flavours).otherwise(F.array().cast("array<string>"))
    image = F.when(F.col("l_orderkey") % 3 == 0, "one")
    return orders.select(
        "l_orderkey", L.cover_of(images, image).alias("cover"),
        F.array_join(L.first_chips(flavours), " ").alias("chips"),
        F.size(L.images_of(images, image)).alias("n_images"))


@query("slug_lookup", """
SELECT p_partkey, p_brand, 'red-ring' AS slug FROM part WHERE p_name = 'red ring' ORDER BY p_partkey LIMIT 1""")
def slug_lookup(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select(
        "p_partkey", "p_brand", F.translate("p_name", " ", "-").alias("slug"), F.col("p_partkey").alias("ord"))
    return browse.by_slug(rows, "red-ring").drop("ord")


@query("diary_entries", """
WITH notes AS (SELECT doc_id % (SELECT count(*) FROM part) AS p_partkey, min(text) AS story FROM documents GROUP BY 1),
rows AS (SELECT p.*, story FROM part p LEFT JOIN notes USING (p_partkey)),
specs AS (
  SELECT p_partkey, 0 AS ord, 'producer' AS label, p_brand AS value FROM part
  UNION ALL SELECT p_partkey, 2, 'altitude', p_size || ' m' FROM part WHERE p_size % 2 = 0
  UNION ALL SELECT p_partkey, 3, 'varietal', p_name FROM part WHERE p_size % 3 = 0
  UNION ALL SELECT p_partkey, 4, 'process', p_type FROM part)
SELECT r.p_partkey, 'bean-' || r.p_partkey AS slug, p_name AS bean_name, p_brand AS roaster,
  CASE p_size % 3 WHEN 0 THEN 'var(--wash-peach)' WHEN 1 THEN 'var(--wash-cocoa)' ELSE 'var(--wash-pink)' END AS theme,
  CAST(CASE WHEN story IS NULL THEN 0 ELSE len(string_split('{"The "' || story || chr(10) || chr(10) || 'end', chr(10) || chr(10))) END AS INT) AS n_paragraphs,
  CASE WHEN story IS NULL THEN '' ELSE '{"The "' || story || chr(10) || chr(10) || 'end' END AS story, s.ord, s.label, s.value
FROM rows r JOIN specs s USING (p_partkey)""")
def diary_entries(spark, sf_dir):
    parts = table(spark, sf_dir, "part")
    # as many parts as there are: a one-row table, joined so that nothing goes through the driver
    count = parts.agg(F.count("*").alias("n"))
    notes = table(spark, sf_dir, "documents").join(F.broadcast(count)).groupBy(
        (F.col("doc_id") % F.col("n")).alias("p_partkey")).agg(F.min("text").alias("story"))
    story = F.col("story")
    entry = F.struct(
        text_of("bean-", F.col("p_partkey").cast("string")).alias("slug"), F.lit("2026-07-27").alias("date"),
        F.struct(F.lit("豆").alias("zh"), F.col("p_name").alias("en")).alias("bean_name"), F.col("p_brand").alias("roaster"),
        F.when(F.col("p_size") % 3 == 0, "peach").when(F.col("p_size") % 3 == 1, "cocoa")
        .otherwise("none such").alias("color"),
        F.when(F.col("story").isNotNull(), F.concat(F.lit('{"The "'), story, F.lit("\n\n"), F.lit("end"))).alias("story"),
        F.struct(
            F.col("p_brand").alias("producer"), F.lit("").alias("farm"),
            F.when(F.col("p_size") % 2 == 0, text_of(F.col("p_size").cast("string"), " m")).alias("altitude"),
            F.when(F.col("p_size") % 3 == 0, F.struct(F.col("p_name").alias("zh"))).alias("varietal"),
            F.struct(F.col("p_type").alias("en"), F.lit("法").alias("zh")).alias("process")).alias("details"))
    documents = parts.join(notes, "p_partkey", "left").select(
        F.to_json(F.struct(F.array(entry).alias("entries"))).alias("value"))
    entries = catalogue.diary_entries(documents)
    rows = entries.select(
        F.substring_index("slug", "-", -1).cast("long").alias("p_partkey"), "slug",
        L.in_language(F.col("bean_name"), "en").alias("bean_name"), L.in_language(F.col("roaster"), "zh").alias("roaster"),
        L.theme_of(F.col("color")).alias("theme"),
        F.size(L.paragraphs(L.in_language(F.col("story"), "en"))).alias("n_paragraphs"),
        L.in_language(F.col("story"), "en").alias("story"), "details")
    return rows.select(
        *[c for c in rows.columns if c != "details"], F.inline(L.spec_rows(F.col("details"))))
