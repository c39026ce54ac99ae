"""Captured JSON feeds to products, with a reason where there are none.

Input is the table of captured payloads (``schemas.PAYLOAD``) with the shop
columns of ``with_shops``.  A reader parses, filters and prices products but
leaves the text alone; ``operators.extract.items`` reads the fields later, once,
for the products that were chosen.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelf import schemas
from shelf.functions import prices, roast, rules
from shelf.functions.text import blank, clean_text, filled, unnest, with_page_text
from shelf.functions.urls import site_root
from shelf.operators.extract import as_products
from shelf.operators.grouping import title_groups
from shelf.session import written

SHOP_COLUMNS = ("price_variant_filter", "skip_sources", "tag_aliases")
_SHOP_TYPES = ("string", "array<string>", "map<string,array<string>>")


def with_shops(payloads: DataFrame, config: DataFrame | None = None) -> DataFrame:
    """Add the shop's size and rules.  The size of the config decides how it is joined."""
    if config is None:
        return payloads.withColumns({
            c: F.lit(None).cast(t) for c, t in zip(SHOP_COLUMNS, _SHOP_TYPES)})
    return payloads.join(config.select("roaster", *SHOP_COLUMNS), "roaster", "left")


def collection_products(payloads: DataFrame, details: DataFrame | None = None,
                        whole_shop: bool = False) -> DataFrame:
    """Products of collection feeds.

    ``whole_shop`` reads all-products feeds: the block list then sees the tags
    too, and price and roast come from the listing alone.  ``details`` (roaster,
    handle, http_status, body) are captured product details; a product without
    a usable one keeps its listed price.
    """
    good = payloads.where("http_status = 200")
    rows = unnest(
        good, F.from_json("body", schemas.COLLECTION)["products"], "ord", "p",
        "roaster", "strategy", "candidate_ord", "listing_url", *SHOP_COLUMNS)
    tags = F.array_join(F.coalesce("p.tags", F.array().cast("array<string>")), " ")
    rows = rows.withColumns({"title": clean_text(F.col("p.title")), "tag_text": tags})
    shown = F.concat_ws(" ", "title", "tag_text") if whole_shop else F.col("title")
    rows = rows.where(
        (F.col("title") != "") & ~prices.sold_out(F.col("p.variants"))
        & ~rules.is_blocked_for(F.col("roaster"), shown, cleaned=not whole_shop))
    size = F.lit(None).cast("string") if whole_shop else F.col("price_variant_filter")
    handle = filled(F.col("p.handle"))
    rows = rows.withColumns({
        "handle": handle,
        "price": prices.variant_price(F.col("p.variants"), size),
        "product_url": F.coalesce(
            F.concat(site_root(F.col("listing_url")), F.lit("/products/"), handle), F.col("listing_url")),
        "tags": F.col("p.tags"),
    })
    if details is not None and not whole_shop:
        rows = with_details(rows, details)
    rows = with_page_text(rows, body=F.col("p.body_html"))
    shown_roast = None if whole_shop else roast.listed_roast(
        F.col("title"), F.transform("p.variants", lambda v: v.title), F.col("tags"))
    return as_products(
        rows, text=F.concat_ws(" ", "title", "tag_text", "body"), shown_roast=shown_roast)


def with_details(rows: DataFrame, details: DataFrame) -> DataFrame:
    """Look up the product detail: drop what is out of stock, take its AUD price.

    Only the variants that the rules read are kept before the join.  Of several
    captures of a handle the first counts, by ``candidate_ord`` where details have one
    (they are then kept apart by host variant) and else by ``url``.
    """
    read = details.where("http_status = 200")
    keys = ["roaster", "handle"] + ["candidate_ord"] * ("candidate_ord" in read.columns and "candidate_ord" in rows.columns)
    order = F.col("url") if "url" in read.columns else F.xxhash64("body")
    read = read.select(*keys, order.alias("_at"), F.from_json("body", schemas.DETAIL)["product"]["variants"].alias("dv"))
    read = read.groupBy(*keys).agg(F.min_by("dv", "_at").alias("dv"))
    joined = rows.join(read, keys, "left")
    return joined.where(~prices.out_of_stock(F.col("dv"))).withColumn(
        "price", prices.detail_price(F.col("dv"), F.col("price_variant_filter"), F.col("price"))
    ).drop("dv")


def _read_pages(payloads: DataFrame, schema: str, pages: int | None, size: int | None) -> DataFrame:
    """Products of a paged feed: of every captured page, in page order.

    A page that is no list voids the source.  A body is parsed once; whether it is a
    list is seen from its first character.  ``pages`` and ``size``, off by default,
    stop after so many pages and behind the first page that is refused or shorter.
    """
    key = ["roaster", "strategy", "candidate_ord"]
    good = F.col("http_status").eqNullSafe(200)
    wanted = payloads if pages is None else payloads.where(F.col("page") <= pages)
    read = wanted.where(good).withColumn("_list", F.from_json("body", schema)).withColumn(
        "_list", F.when(F.coalesce(F.ltrim("body").startswith("["), F.lit(False)), F.col("_list"))).drop("body")
    read = written(read, "pages")
    void = read.where("_list IS NULL").groupBy(*key).agg(F.min("page").alias("_void"))
    if size is None:
        read = read.join(void.select(*key), key, "left_anti")
    else:
        ends = read.select(*key, "page", (F.size("_list") < size).alias("_end")).unionByName(
            wanted.where(~good).select(*key, "page", F.lit(True).alias("_end")))
        stop = ends.groupBy(*key).agg(F.min(F.when(F.col("_end"), F.col("page"))).alias("_stop"))
        stop = stop.join(void, key, "left").where("_void IS NULL OR _void > _stop").drop("_void")
        read = read.join(stop, key).where("_stop IS NULL OR page <= _stop").drop("_stop")
    rows = unnest(read, "_list", "pos", "p", *key, "page", "listing_url", *SHOP_COLUMNS)
    return rows.withColumn("ord", F.shiftleft(F.col("page").cast("long"), 32) + F.col("pos"))


def woo_products(payloads: DataFrame, pages: int | None = None, size: int | None = None) -> DataFrame:
    """Products of a paged store feed, those of one title taken together.

    The first product of a title speaks for it, even if that one is sold out;
    the title goes only if all of them are.  Stock and categories of the group
    are folded as flags, so no group is collected.
    """
    rows = _read_pages(payloads, schemas.WOO, pages, size)
    rows = rows.withColumn("title", clean_text(F.col("p.name"))).where("title <> ''")
    key = ["roaster", "strategy", "candidate_ord", "title"]
    groups = title_groups(
        rows, key, F.col("ord"), F.struct("p", "ord", "listing_url", *SHOP_COLUMNS),
        F.col("p.is_in_stock"), F.transform("p.categories", lambda c: c["name"]))
    first = groups.select(*key, "espresso_seen", "filter_seen", "first.*")

    def joined(entries):
        none = F.array().cast("array<struct<name:string>>")
        return clean_text(F.array_join(
            F.transform(F.coalesce(entries, none), lambda c: blank(c["name"])), " "))

    first = first.withColumns({
        "product_url": clean_text(F.col("p.permalink")),
        "cats": joined(F.col("p.categories")), "tag_text": joined(F.col("p.tags")),
        "price": prices.minor_unit_price(F.col("p.prices.price"), F.col("p.prices.currency_minor_unit")),
    })
    blocked = rules.is_blocked_for(
        F.col("roaster"), F.concat_ws(" ", "title", "product_url", "cats", "tag_text"), cleaned=True)
    first = first.where((F.col("product_url") != "") & ~blocked)
    first = with_page_text(
        first, short=F.col("p.short_description"), long=F.col("p.description"))
    text = F.concat_ws(" ", "title", "short", "long", "cats", "tag_text")
    return as_products(
        first.withColumn("body", text), text=F.col("body"),
        shown_roast=roast.category_roast(F.col("espresso_seen"), F.col("filter_seen")))


def wordpress_products(payloads: DataFrame, pages: int | None = None, size: int | None = None) -> DataFrame:
    """Products of a paged feed of plain posts."""
    rows = _read_pages(payloads, schemas.WORDPRESS, pages, size).withColumns({
        "title": clean_text(F.col("p.title.rendered")), "product_url": clean_text(F.col("p.link"))})
    rows = rows.where((F.col("title") != "") & (F.col("product_url") != ""))
    rows = with_page_text(
        rows, excerpt=F.col("p.excerpt.rendered"), content=F.col("p.content.rendered"))
    shown = F.concat_ws(" ", "title", "product_url", "excerpt")
    rows = rows.where(~rules.is_blocked_for(F.col("roaster"), shown, cleaned=True))
    rows = rows.withColumn("body", F.concat_ws(" ", "title", "excerpt", "content"))
    return as_products(
        rows.withColumn("price", prices.dollar_price(F.col("body"))), text=F.col("body"))


# --- reasons ---------------------------------------------------------------------------

def feed_reasons(payloads: DataFrame, items: DataFrame) -> DataFrame:
    """Why a feed gave no items: (roaster, strategy, candidate_ord, reason).

    A feed that gave items is left out before any body is read.  All-products feeds of
    one host are one source with several addresses: their reason lists each address
    that was refused, broken or empty, or says that none had results.  The reason of a
    discovered collection begins with its handle.
    """
    key = ["roaster", "strategy", "candidate_ord"]
    kind = F.col("strategy")
    paged, whole = kind.isin("woo", "wordpress"), kind == "all_products"
    lost = payloads.join(items.select(*key).distinct(), key, "left_anti")
    # a source of several addresses has items if any of them has
    host = F.floor(F.col("candidate_ord") / 100)
    some = items.where(whole).select("roaster", host.alias("_host")).distinct()
    lost = lost.withColumn("_host", host)
    lost = lost.join(some.withColumn("strategy", F.lit("all_products")), ["roaster", "strategy", "_host"], "left_anti")
    root = F.when(paged, F.col("body")).otherwise(F.get_json_object("body", "$.products"))
    state = lost.select(
        *key, "_host", "page", "url", "http_status", F.json_array_length(root).alias("_n"),
        F.json_array_length("body").isNotNull().alias("_is_list"),
        # a whole-document check: broken JSON has no root
        F.try_parse_json("body").isNotNull().alias("_is_json"))
    name = F.when(kind == "woo", "woocommerce").when(kind == "wordpress", "wp_product").otherwise("shopify_json")
    none = F.when(kind == "wordpress", "no_items").otherwise("no_products")
    refused = F.concat_ws("_", name, F.lit("http"), F.col("http_status").cast("string"))
    first = F.min_by(F.struct("http_status", "url"), "page")
    groups = state.groupBy("roaster", "strategy", "_host", "candidate_ord").agg(
        first.alias("_first"), F.min(F.when(F.col("http_status") != 200, F.col("page"))).alias("_refused_at"),
        F.min("page").alias("_at"), F.coalesce(F.max("_n"), F.lit(0)).alias("_most"),
        # what was never captured failed, as what is no JSON
        F.bool_or(F.col("http_status").isNull() | (F.col("http_status") == 200) & ~F.coalesce("_is_json", F.lit(False))).alias("_broken"),
        F.bool_or((F.col("http_status") == 200) & ~F.coalesce("_is_list", F.lit(False))).alias("_no_list"))
    groups = groups.withColumns({"http_status": F.col("_first.http_status"), "url": F.col("_first.url")})
    code = (
        F.when(F.col("url").isNull(), F.lit("not_a_collection_url"))
        .when(F.col("_refused_at") == F.col("_at"), refused)
        .when(F.col("_broken"), F.concat_ws("_", name, F.lit("error")))
        .when(paged & F.col("_no_list"), F.concat_ws("_", name, F.lit("invalid_payload")))
        .when(F.col("_most") == 0, F.concat_ws("_", name, none))
        .otherwise(F.concat_ws("_", name, F.lit("no_parsed_items"))))
    handle = F.regexp_extract("url", "/collections/([^/]+)/products.json", 1)
    code = F.when((kind == "discovered_collection") & (handle != ""), F.concat(handle, F.lit(":"), code)).otherwise(code)
    single = groups.where(~whole).select(*key, code.alias("reason"))
    # an address of many: its status, that it is broken, or that it lists nothing
    told = F.when(F.col("http_status") != 200, F.concat(F.lit("http_"), F.col("http_status").cast("string"))).when(
        F.col("_broken"), F.lit("error")).when(F.col("_most") == 0, F.lit("no_products"))
    address = F.struct("candidate_ord", F.concat("url", F.lit(":"), told).alias("told"))
    many = groups.where(whole).groupBy("roaster", "strategy", "_host").agg(
        F.min("candidate_ord").alias("candidate_ord"),
        F.array_sort(F.collect_list(F.when(told.isNotNull(), address))).alias("_told"))
    many = many.select(*key, F.when(
        F.size("_told") > 0, F.concat(F.lit("shopify_all_json_failed: "), F.array_join("_told.told", "; "))).otherwise(
        F.lit("shopify_all_json_no_results")).alias("reason"))
    return single.unionByName(many)
