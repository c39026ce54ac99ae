"""Queries: field extraction, guards, free-text rules, roast profiles."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelf import vocabulary as V
from shelf.functions import fields, guards, roast
from shelf.plans.registry import query, table
from shelf.session import spread

TERMS = ["Washed", "Natural", "Honey", "Pulped Natural", "Anaerobic"]


def pick(options, n):
    """The option at position ``n`` modulo their number."""
    return F.element_at(F.array(*[F.lit(x) for x in options]), (n % len(options) + 1).cast("int"))


def sql_pick(options, n):
    return "[" + ", ".join(f"'{o}'" for o in options) + f"][{n} % {len(options)} + 1]"


def choose(by, *cases):
    """The case at position ``by`` modulo their number; each case is built from columns."""
    out = F.when(by % len(cases) == 0, cases[0])
    for i, case in enumerate(cases[1:], 1):
        out = out.when(by % len(cases) == i, case)
    return out


def text_of(*parts):
    return F.concat(*[p if not isinstance(p, str) else F.lit(p) for p in parts])


def parts_with_nation(spark, sf_dir):
    parts = table(spark, sf_dir, "part").withColumn(
        "n_nationkey", (F.col("p_partkey") % 25).cast("int"))
    nations = table(spark, sf_dir, "nation").join(
        table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return parts.join(nations, "n_nationkey").withColumn("term", pick(TERMS, F.col("p_size")))


_PARTS = f"""
WITH parts AS (
  SELECT p.*, n_name, r_name, {sql_pick(TERMS, 'p_size')} AS term
  FROM part p JOIN nation ON n_nationkey = p_partkey % 25 JOIN region ON n_regionkey = r_regionkey)
"""


@query("tag_fields", _PARTS + """
SELECT p_partkey, n_name AS origin, term AS process, '' AS varietal, p_name || ', ' || lower(p_type) AS flavour
FROM parts""")
def tag_fields(spark, sf_dir):
    tags = F.array(
        text_of("ORIGIN_", F.col("n_name")), text_of("COUNTRY: ", F.col("r_name")),
        text_of("Process: ", F.col("term")), text_of("Taste  Notes.", F.col("p_name")), F.lit("plain"),
        text_of(" processing : ", F.col("term"), " "), text_of("flavor_", F.lower("p_type")))
    rows = parts_with_nation(spark, sf_dir).select("p_partkey", tags.alias("tags"))
    return rows.select("p_partkey", fields.tag_fields(F.col("tags")).alias("f")).select("p_partkey", "f.*")


def product_text(spark, sf_dir):
    """Labelled text of a part, with the place of its first supplier."""
    first = table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("p_partkey")).agg(
        F.min("l_suppkey").alias("s_suppkey"))
    places = (
        table(spark, sf_dir, "supplier")
        .join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
        .join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
        .select("s_suppkey", "n_name", "r_name"))
    rows = table(spark, sf_dir, "part").join(first, "p_partkey").join(places, "s_suppkey")
    return rows.select("p_partkey", text_of(
        "Sweet and round. Origin: ", F.col("n_name"), ", ", F.col("r_name"), " Process: ",
        pick(TERMS, F.col("p_size")), " ALTITUDE Varietal: ", F.col("p_type"), " Farm - Z Notes: ",
        F.col("p_name"), ", ", F.lower("p_type"), ". tail Origin: Elsewhere").alias("text"))


@query("label_fields", f"""
SELECT p_partkey, n_name || ', ' || r_name AS raw_origin, {sql_pick(TERMS, 'p_size')} || ' ALTITUDE' AS raw_process,
       n_name || ', ' || r_name AS origin, {sql_pick(TERMS, 'p_size')} AS process, p_type AS varietal,
       p_name || ', ' || lower(p_type) AS flavour
FROM part JOIN (SELECT l_partkey, min(l_suppkey) AS s_suppkey FROM lineitem GROUP BY 1) f ON l_partkey = p_partkey
JOIN supplier USING (s_suppkey) JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""")
def label_fields(spark, sf_dir):
    raw = product_text(spark, sf_dir).select("p_partkey", fields.raw_fields(None, F.col("text")).alias("raw"))
    return raw.select(
        "p_partkey", F.col("raw.origin").alias("raw_origin"), F.col("raw.process").alias("raw_process"),
        *[guards.GUARDS[f](F.col("raw")[f]).alias(f) for f in V.FIELDS])


@query("process_whitelist", f"""
WITH picked AS (
  SELECT p_partkey, {sql_pick(V.PROCESS_PHRASES, 'p_size')} AS a, {sql_pick(V.PROCESS_PHRASES, 'p_partkey')} AS b,
         p_size % {len(V.PROCESS_PHRASES)} AS i, p_partkey % {len(V.PROCESS_PHRASES)} AS j FROM part)
SELECT p_partkey, CASE WHEN contains(a, b) THEN a WHEN contains(b, a) THEN b WHEN i < j THEN a || ', ' || b
                       ELSE b || ', ' || a END AS process FROM picked""")
def process_whitelist(spark, sf_dir):
    raw = text_of("A ", F.upper(pick(V.PROCESS_PHRASES, F.col("p_size"))), " & ",
                  F.lower(pick(V.PROCESS_PHRASES, F.col("p_partkey"))), " REGION unwashed")
    rows = table(spark, sf_dir, "part").select("p_partkey", raw.alias("raw"))
    return rows.select("p_partkey", guards.process_guard(F.col("raw")).alias("process"))


@query("varietal_guard", """
SELECT p_partkey, CASE p_size % 6 WHEN 0 THEN p_type || ', ' || p_name WHEN 1 THEN p_name WHEN 2 THEN ''
  WHEN 3 THEN p_type WHEN 4 THEN p_name ELSE p_type END AS varietal FROM part""")
def varietal_guard(spark, sf_dir):
    name, kind = F.col("p_name"), F.col("p_type")
    raw = choose(
        F.col("p_size"),
        text_of(kind, ", ", name, ", COLOMBIA CUP"), text_of(name, " CUP: HONEY"), text_of("his ", name),
        text_of(kind, " In the hills of ", name), text_of(name, ": x"), text_of(kind, ", , Kenya,"))
    return table(spark, sf_dir, "part").select("p_partkey", raw.alias("raw")).select(
        "p_partkey", guards.varietal_guard(F.col("raw")).alias("varietal"))


_KNOWN = "r_name IN ('AFRICA', 'AMERICA', 'ASIA')"


@query("origin_guard", _PARTS + f"""
SELECT p_partkey, CASE p_size % 6 WHEN 0 THEN n_name || ', ' || r_name WHEN 1 THEN CASE WHEN {_KNOWN} THEN r_name ELSE '' END
  WHEN 2 THEN '' WHEN 3 THEN n_name || ', ' || r_name WHEN 4 THEN n_name || ', ' || r_name
  ELSE CASE WHEN {_KNOWN} THEN 'Known ' || r_name ELSE '' END END AS origin FROM parts""")
def origin_guard(spark, sf_dir):
    nation, region = F.col("n_name"), F.col("r_name")
    raw = choose(
        F.col("p_size"),
        text_of(nation, ", ", region, ", delivers notes of milk"), region, text_of("the ", nation, ", x"),
        text_of(nation, ", ", region, " | ", nation), text_of(" ", nation, ", ", region, ". tail"),
        text_of("Known ", region))
    return parts_with_nation(spark, sf_dir).select("p_partkey", raw.alias("raw")).select(
        "p_partkey", guards.origin_guard(F.col("raw")).alias("origin"))


@query("flavour_guard", """
SELECT p_partkey, CASE p_size % 6 WHEN 0 THEN p_name || ', ' || lower(p_type) WHEN 1 THEN ''
  WHEN 2 THEN 'chocolate ' || p_name WHEN 3 THEN '' WHEN 4 THEN p_name || ', honey'
  ELSE p_name || ', plum' END AS flavour FROM part""")
def flavour_guard(spark, sf_dir):
    name = F.col("p_name")
    raw = choose(
        F.col("p_size"),
        text_of(name, ", ", F.lower("p_type"), " 50% x"), name, text_of("chocolate ", name, " and"),
        text_of("with ", name, ", x"), text_of(name, ", honey | z"), text_of(name, ", plum The end"))
    return table(spark, sf_dir, "part").select("p_partkey", raw.alias("raw")).select(
        "p_partkey", guards.flavour_guard(F.col("raw")).alias("flavour"))


@query("origin_heuristic", _PARTS + """
SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN r_name WHEN 1 THEN 'Kenya ' || r_name WHEN 2 THEN 'Congo, Dr Congo, Peru'
  ELSE '' END AS origin FROM parts""")
def origin_heuristic(spark, sf_dir):
    region = F.col("r_name")
    raw = choose(
        F.col("p_size"),
        text_of("a country: ", region, ". More Process"), text_of("grown in Kenya ", region, " variety; x"),
        text_of("from ", region, ". peru and dr congo"), F.col("p_name"))
    return parts_with_nation(spark, sf_dir).select("p_partkey", raw.alias("raw")).select(
        "p_partkey", fields.origin_from_text(F.col("raw")).alias("origin"))


_TERM = sql_pick(TERMS, "p_size")
_SHORT = f"CASE {_TERM} WHEN 'Pulped Natural' THEN 'Natural' ELSE {_TERM} END"


@query("process_heuristic", f"""
SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN lower({_TERM}) || ' lot' ELSE {_SHORT} END AS process FROM part""")
def process_heuristic(spark, sf_dir):
    term = pick(TERMS, F.col("p_size"))
    way = F.col("p_partkey")
    raw = choose(
        way, text_of("Processing - ", F.lower(term), " lot. Origin"), text_of("wet hulled"),
        text_of("experimental"), text_of("an ", F.upper(term), "!"))
    title = choose(way, F.lit("x"), text_of(term, " lot"), F.lit("y"), F.lit("z"))
    url = choose(
        way, F.lit(""), F.lit("https://a.b/honey"),
        text_of("https://a.b/products/", F.translate(F.lower(term), " ", "-"), "?honey"), F.lit(""))
    rows = table(spark, sf_dir, "part").select(
        "p_partkey", raw.alias("raw"), title.alias("title"), url.alias("url"))
    found = fields.process_from_text(F.col("raw"), F.col("title"), F.col("url"))
    return rows.select("p_partkey", found.alias("process"))


@query("varietal_heuristic", """
SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN p_name WHEN 1 THEN p_type || ' (' || p_size || ')' ELSE '' END AS varietal
FROM part""")
def varietal_heuristic(spark, sf_dir):
    raw = choose(
        F.col("p_size"), text_of("x Varieties: ", F.col("p_name"), " notes of x"),
        text_of("Cultivar - ", F.col("p_type"), " (", F.col("p_size").cast("string"), "); x"),
        text_of("a variety of ", F.col("p_name")))
    return table(spark, sf_dir, "part").select("p_partkey", raw.alias("raw")).select(
        "p_partkey", fields.varietal_from_text(F.col("raw")).alias("varietal"))


@query("flavour_heuristic", """
SELECT p_partkey, CASE p_size % 5 WHEN 0 THEN p_name || ', ' || lower(p_type) WHEN 1 THEN p_name || ' and caramel'
  WHEN 2 THEN '' WHEN 3 THEN p_name || ', plum' ELSE 'citrus ' || p_name END AS flavour FROM part""")
def flavour_heuristic(spark, sf_dir):
    name = F.col("p_name")
    raw = choose(
        F.col("p_size"),
        text_of("CUP: ", name, ", ", F.lower("p_type"), ". x"), text_of("Tastes like ", name, " and caramel recipe z"),
        text_of("notes: ", name, " dose"), text_of("cup ", name, ", plum. z"),
        text_of("cup: ", name, " profile is. Flavour - citrus ", name, " Roast light"))
    return table(spark, sf_dir, "part").select("p_partkey", raw.alias("raw")).select(
        "p_partkey", fields.flavour_from_text(F.col("raw")).alias("flavour"))


@query("field_resolution", _PARTS + f"""
SELECT p_partkey,
  CASE p_partkey % 4 WHEN 0 THEN n_name || ', ' || r_name WHEN 1 THEN n_name || ', Peru' WHEN 2 THEN 'kenya' ELSE '' END AS origin,
  CASE p_partkey % 4 WHEN 0 THEN term WHEN 1 THEN 'Fully Washed' WHEN 2 THEN {_SHORT} ELSE 'Washed' END AS process,
  CASE p_partkey % 4 WHEN 1 THEN p_type ELSE '' END AS varietal,
  CASE p_partkey % 4 WHEN 0 THEN 'honey ' || p_name WHEN 1 THEN p_name || ', plum' WHEN 2 THEN p_name || ' and caramel'
       ELSE '' END AS flavour_profile
FROM parts""")
def field_resolution(spark, sf_dir):
    way, name, term = F.col("p_partkey"), F.col("p_name"), F.col("term")
    none = F.array().cast("array<string>")
    tags = choose(
        way, F.array(text_of("Origin: ", F.col("n_name"), ", ", F.col("r_name")), text_of("PROCESSING_", term, " lot"),
                     text_of("note.honey ", name)), none, none, F.array(text_of("Process: ", name)))
    body = choose(
        way, F.lit("Origin: Elsewhere, Peru Process: washed"),
        text_of("Origin: ", F.col("n_name"), ", Peru Process: FULLY washed ALTITUDE Variety: ", F.col("p_type"),
                " Tasting notes: ", name, ", plum"),
        text_of("grown in kenya. ", F.upper(term), " beans that tastes like ", name, " and caramel. x"),
        F.lit("Process: washed"))
    rows = parts_with_nation(spark, sf_dir).select(
        "p_partkey", tags.alias("tags"), body.alias("body"), text_of(name, " ", body).alias("text"),
        F.lit("").alias("title"), F.lit("").alias("url"))
    found = fields.with_fields(rows, text="text", body="body", tags="tags", title="title", url="url")
    return found.select("p_partkey", "origin", "process", "varietal", "flavour_profile")


@query("roast_profile", """
SELECT p_partkey, CASE p_size % 8 WHEN 0 THEN 'filter' WHEN 1 THEN 'omni' WHEN 2 THEN 'omni' WHEN 3 THEN 'espresso'
  WHEN 4 THEN 'filter' WHEN 5 THEN 'espresso' WHEN 6 THEN 'omni' ELSE '' END AS roast_profile,
  CASE WHEN p_size % 8 = 0 THEN 'pink' WHEN p_size % 8 IN (3, 5) THEN 'green' WHEN p_size % 8 = 4 THEN 'pink'
       WHEN p_size % 8 = 7 THEN '' ELSE 'blue' END AS colour
FROM part""")
def roast_profile(spark, sf_dir):
    way, name = F.col("p_size"), F.col("p_name")
    none = F.array().cast("array<string>")
    title = choose(way, text_of("Filter ", name), text_of("filter & ESPRESSO ", name), *[name] * 6)
    variants = choose(
        way, F.array(F.lit("espresso")), none, F.array(F.lit("Plunger 250g"), F.lit("ESPRESSO grind")), none, none,
        F.array(F.lit("Filter")), none, none)
    tags = choose(
        way, F.array(F.lit("Roast: espresso")), none, F.array(F.lit("ROAST: filter")),
        F.array(F.lit("Brew Method.Pour over"), F.lit("Coffee Type. Espresso")),
        F.array(F.lit("brew method V60"), F.lit("x")), none, none, F.array(F.lit("ROAST: light")))
    text = choose(
        way, F.lit("omni"), F.lit(""), F.lit(""), F.lit("filter"), F.lit("espresso"), F.lit("An espresso"),
        F.lit("for pour over or Espresso"), F.lit("filter"))
    rows = table(spark, sf_dir, "part").select(
        "p_partkey", title.alias("title"), variants.alias("variants"), tags.alias("tags"), text.alias("text"))
    profile = F.coalesce(
        roast.listed_roast(F.col("title"), F.col("variants"), F.col("tags")), roast.roast_of_text(F.col("text")))
    return rows.select("p_partkey", profile.alias("roast_profile")).withColumn(
        "colour", roast.roast_colour(F.col("roast_profile")))


@query("refused_values", """
SELECT p_partkey, 'origin' AS field, 'Lot ' || p_size AS value, '' AS kept FROM part WHERE p_size % 3 <> 0
UNION ALL SELECT p_partkey, 'process', 'Odd way ' || p_size, CASE WHEN p_size % 2 = 0 THEN 'Honey' ELSE '' END FROM part
UNION ALL SELECT p_partkey, 'process_text', 'Odd text', '' FROM part WHERE p_size % 2 = 1""")
def refused_values(spark, sf_dir):
    from shelf.operators.extract import PRODUCT, items

    # labels that no guard takes, and free text that is taken for every second part
    size, key = F.col("p_size").cast("string"), F.col("p_partkey").cast("string")
    given = {
        "roaster": F.lit("a shop"), "strategy": F.lit("collection"), "candidate_ord": F.lit(0), "ord": F.col("p_partkey"),
        "title": F.lit("A bean"), "status": F.lit("ok"), "error": F.lit(""),
        "tags": F.array(text_of("Origin: Lot ", size, F.when(F.col("p_size") % 3 == 0, ", Kenya").otherwise("")), text_of("Process: Odd way ", size)),
        "body": F.lit(""), "text": F.when(F.col("p_size") % 2 == 0, F.lit("Process: Honey")).otherwise(text_of("Process: Odd text ", key))}
    rows = spread(table(spark, sf_dir, "part")).select(*[given.get(c, F.lit("" if t == "string" else None)).cast(t).alias(c) for c, t in PRODUCT.items()])
    found = items(rows)
    # the outer form, for before the plain one Spark works out all fields once more, to drop empty maps
    listed = found.select(F.col("ord").alias("p_partkey"), "origin", "process", F.explode_outer("refused").alias("field", "value"))
    return listed.where("field IS NOT NULL").select(
        "p_partkey", "field", "value", F.when(F.col("field") == "origin", F.col("origin")).otherwise(F.col("process")).alias("kept"))
