"""The whole collection run over captured data: every source, then the cascade.

A capture's ``candidate_ord`` is ``100 * host variant + candidate``; host
variant 0 is the configured address, 1 the one with 'www.' toggled.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelf import vocabulary as V
from shelf.functions.urls import other_www, site_root
from shelf.operators import crawl, extract
from shelf.session import written
from shelf.sources import catalogue, feeds, pages

HOST = 100


def priority(strategy: Column, host: Column) -> Column:
    """All strategies of the first host come before any of the second."""
    order = F.array(*[F.lit(s) for s in V.STRATEGIES])
    return (host * len(V.STRATEGIES) + F.array_position(order, strategy) - 1).cast("int")


def host_of(candidate: Column) -> Column:
    return F.floor(candidate / HOST)


def allowed(config: DataFrame) -> DataFrame:
    """(roaster, strategy) pairs that a shop's switches leave."""
    strategy = F.explode(F.array(*[F.lit(s) for s in V.STRATEGIES])).alias("strategy")
    pairs = config.select(
        "roaster", "force_html_listing", "force_woo_api", "shopify_collection_handle", strategy)
    feed = F.col("strategy").isin("collection", "discovered_collection")
    keep = (
        F.when(feed & F.col("force_html_listing"), False)
        .when((F.col("strategy") == "discovered_collection") & F.col("shopify_collection_handle").isNotNull(), False)
        .when(F.col("force_woo_api"), feed | (F.col("strategy") == "woo"))
        .otherwise(True))
    return pairs.where(keep).select("roaster", "strategy")


def source_products(config: DataFrame, payloads: DataFrame, details: DataFrame | None = None,
                    listings: DataFrame | None = None, captured_pages: DataFrame | None = None,
                    sitemap_found: DataFrame | None = None) -> DataFrame:
    """Products of every allowed strategy and candidate, not yet chosen between.
    They are parsed once and written; all later steps read that table.

    ``listings`` are captured listing pages with a strategy; ``sitemap_found``
    (site, listing_url, url, ord, pos and, for the second host variant, candidate_ord)
    comes from ``crawl.expand_sitemaps``.
    """
    allow = allowed(config)
    payloads = feeds.with_shops(payloads.join(allow, ["roaster", "strategy"]), config)

    def of(*names):
        return payloads.where(F.col("strategy").isin(*names))

    # a discovered collection is read without the shop's size
    found = of("discovered_collection").withColumn("price_variant_filter", F.lit(None).cast("string"))
    products = (
        feeds.collection_products(of("collection"), details)
        .unionByName(feeds.collection_products(found, details))
        .unionByName(feeds.collection_products(of("all_products"), whole_shop=True))
        .unionByName(feeds.woo_products(of("woo")))
        .unionByName(feeds.wordpress_products(of("wordpress"))))
    links = []
    if listings is not None:
        for name in pages.LINKS:
            own = listings.where(F.col("strategy") == name).join(allow, ["roaster", "strategy"])
            links.append(pages.listing_links(feeds.with_shops(own, config), name))
    if sitemap_found is not None:
        # which host variant's sitemaps they are; the configured one if nothing is said
        known = "candidate_ord" in sitemap_found.columns
        host = (F.col("candidate_ord") if known else F.lit(0)).alias("candidate_ord")
        found = pages.sitemap_links(sitemap_found).select(
            F.col("site").alias("roaster"), "listing_url", "ord", F.col("url").alias("product_url"),
            host, F.lit("sitemap").alias("strategy"))
        links.append(feeds.with_shops(found.join(allow, ["roaster", "strategy"]), config))
    if links:
        # all links together, so that each captured page is read once
        every = functools.reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), links)
        products = products.unionByName(pages.linked_products(written(every, "links"), captured_pages))
    return pages.not_skipped(written(products, "products"))


def host_variants(config: DataFrame) -> DataFrame:
    """The addresses to try for a shop: the configured one and the one with 'www.' toggled."""
    named = config.where("listing_url IS NOT NULL").select("roaster", "listing_url")
    other = named.withColumn("listing_url", other_www(F.col("listing_url"))).where("listing_url IS NOT NULL")
    return named.withColumn("candidate_ord", F.lit(0)).unionByName(other.withColumn("candidate_ord", F.lit(HOST)))


def sitemap_source(config: DataFrame, documents: DataFrame, captured_pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The sitemap strategy as one run over captured documents (url, http_status, body), for
    both host variants: the usual places and what robots files name, the files they lead
    to, the product pages, and why there are none.

    Returns products, skipped pages included, and reasons (roaster, strategy, candidate_ord,
    listing_url, reason).  Both variants are one expansion, told apart by their site.
    """
    site = F.struct("roaster", "candidate_ord").alias("site")
    sites = written(host_variants(config).select(site, "listing_url"), "sites")
    robots = sites.withColumn("url", F.concat(site_root(F.col("listing_url")), F.lit("/robots.txt"))).join(documents.hint("merge"), "url")
    seeds = crawl.usual_seeds(sites).unionByName(crawl.robots_seeds(robots), allowMissingColumns=True)
    found, errors = crawl.expand_sitemaps(documents, seeds.select("site", "listing_url", "url", "ord"))
    found = written(found, "found")
    links = feeds.with_shops(
        pages.sitemap_links(found).join(sites, "site").select(
            "site.*", "listing_url", "ord", F.col("url").alias("product_url"), F.lit("sitemap").alias("strategy")), config)
    products = written(pages.linked_products(written(links, "links"), captured_pages), "products")
    judged = products.select(F.struct("roaster", "candidate_ord").alias("roaster"), "status")
    told = pages.sitemap_reasons(sites, errors, found, judged).withColumnRenamed("roaster", "site").join(sites, "site")
    return products, told.select("site.*", F.lit("sitemap").alias("strategy"), "listing_url", "reason")


def chosen_source(products: DataFrame) -> DataFrame:
    """Per shop the products of its first strategy that has any; where a strategy
    has several candidates, of the one with most rows, the earlier on ties.

    All deciding is done on a table of counts, which is then joined back once.
    """
    key = ["roaster", "strategy", "candidate_ord"]
    sizes = products.groupBy(*key).agg(F.count("*").alias("n"))
    order = F.struct(
        priority(F.col("strategy"), host_of(F.col("candidate_ord"))), -F.col("n"), "candidate_ord")
    best = sizes.groupBy("roaster").agg(
        F.min_by(F.struct("strategy", "candidate_ord"), order).alias("best"))
    return products.join(best.select("roaster", "best.*"), key)


def collect(config: DataFrame, products: DataFrame, reasons: DataFrame) -> DataFrame:
    """Per shop the items of its first source that has any; a shop without gets
    one error row that tells why.  Fields are read only for what was chosen.

    ``reasons``: roaster, candidate_ord, listing_url, strategy, reason, of feeds
    (``feeds.feed_reasons``), listings and sitemaps (``pages.listing_reasons``,
    ``pages.sitemap_reasons``) - at most a few per shop and handle, so joining their
    texts stays small.
    """
    chosen = extract.items(chosen_source(products))
    named = config.where("listing_url IS NOT NULL")
    lost = named.join(products.select("roaster").distinct(), "roaster", "left_anti")
    told = reasons.withColumn("host", host_of(F.col("candidate_ord"))).withColumn(
        "rank", priority(F.col("strategy"), F.col("host")))
    # what was tried with discovered handles is one message, behind all others
    handles = F.array_sort(F.collect_list(F.struct("candidate_ord", "reason")))
    discovery = told.where("strategy = 'discovered_collection'").groupBy("roaster", "host", "listing_url").agg(
        F.concat(F.lit("handle_discovery="), F.array_join(F.transform(handles, lambda h: h["reason"]), "; ")).alias("reason"))
    told = told.where("strategy <> 'discovered_collection'").unionByName(
        discovery.withColumn("rank", F.lit(1 << 30)), allowMissingColumns=True)
    told = told.groupBy("roaster", "host", "listing_url").agg(
        F.array_join(F.transform(F.array_sort(F.collect_set(F.struct("rank", "reason"))),
                                 lambda r: r["reason"]), " | ").alias("told"))
    told = told.groupBy("roaster").agg(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("host", "listing_url", "told"))),
        lambda r: F.concat(r["listing_url"], F.lit(" => "), r["told"])), " || ").alias("error"))
    failed = lost.join(told.hint("merge"), "roaster", "left").select(*catalogue.error_item(
        F.coalesce("error", F.lit("unknown_scrape_error")), source_url=F.col("listing_url")))
    unnamed = catalogue.shops_without_address(config)
    return chosen.unionByName(failed.unionByName(unnamed), allowMissingColumns=True)
