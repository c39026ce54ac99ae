"""Captured HTML: product pages to items, listing pages and sitemaps to links."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelf import vocabulary as V
from shelf.functions import prices, rules
from shelf.functions.text import blank, filled, let, plain_text, unnest, with_page_text
from shelf.functions.urls import collection_handles, handle_score, product_links, shop_links, url_path
from shelf.operators.extract import as_products
from shelf.operators.select import top_per_group


def _meta(html: Column, prop: str) -> Column:
    """Content of the first ``meta`` with that property, attributes in any order."""
    return F.regexp_extract(
        html,
        rf"""(?is)<meta\b(?=[^>]*\bproperty\s*=\s*["']{prop}["'])[^>]*?\bcontent\s*=\s*(["'])(.*?)\1""", 2)


def with_page_title(df: DataFrame, html: Column, out: str = "title") -> DataFrame:
    """``og:title``, else the first heading."""
    meta = _meta(html, "og:title")
    heading = F.regexp_extract(html, r"(?is)<h1\b[^>]*>(.*?)</h1\s*>", 1)
    return with_page_text(df, **{out: F.when(plain_text(meta) != "", meta).otherwise(heading)})


_VOID = r"(?!(?:area|base|br|col|embed|hr|img|input|link|meta|source|track|wbr)\b)"


def _opening(class_pattern: str) -> str:
    """The first start tag with such a class, and all that follows it."""
    return (rf"""(?is)<{_VOID}([a-z][^\s/>]*)(?=[\s/>])[^>]*?\sclass\s*=\s*(?:"{class_pattern.format(q='"')}"|"""
            rf"""'{class_pattern.format(q="'")}')[^>]*>(.*)""")


_TOKEN = r"(?:[^{{q}}]*\s)?{name}(?:\s[^{{q}}]*)?"
_PRICE_ELEMENTS = [
    _opening(_TOKEN.format(name="price")),
    _opening(_TOKEN.format(name="woocommerce-Price-amount")),
    _opening(r"[^{q}]*price[^{q}]*"),
]


def element_text(name: Column, rest: Column) -> Column:
    """What stands in an element: of all that follows its start tag, the part up to the
    end tag that closes it, however deep its own name nests in it.  An element that is never
    closed holds all that follows.  Both columns are used several times, so bind them first.

    The text is cut before the tags of that name alone; they raise or lower a running
    depth, and the first piece that brings it to none is the end."""
    quoted = F.replace(name, F.lit("\\E"), F.lit("\\E\\\\E\\Q"))
    own = F.concat(F.lit("(?iu)(?=</?\\Q"), quoted, F.lit("\\E(?:[\\s/>]|</?[A-Za-z]|\\z))"))
    # the blank in front keeps a tag that comes at once out of the first piece
    pieces = F.split(F.concat(F.lit(" "), rest), own)

    def step(state: Column, piece: Column) -> Column:
        change = F.when(piece.startswith("</"), -1).when(piece.startswith("<"), 1).otherwise(0)
        depth = F.when(state.depth > 0, state.depth + change).otherwise(state.depth)
        return F.struct(depth.alias("depth"), F.when(depth > 0, state.n + 1).otherwise(state.n).alias("n"))

    start = F.struct(F.lit(1).alias("depth"), F.lit(0).alias("n"))
    inner = let(pieces, lambda p: F.array_join(F.slice(p, 1, F.aggregate(p, start, step).n), "")).substr(F.lit(2), F.length(rest) + 1)
    # a name that runs into another tag is no tag's, so nothing closes it
    return F.when(name.rlike("<[A-Za-z]"), rest).otherwise(inner)


def _shown_price(html: Column, opening: str) -> Column:
    """The first dollar amount in the first element of a kind; NULL without one or if it is
    a plain '0'.  The page is searched once; all else looks at what was found."""
    def inner(found: Column) -> Column:
        parts = F.struct(F.lower(F.regexp_extract(found, r"(?i)^<([a-z][^\s/>]*)", 1)).alias("name"),
                         F.regexp_extract(found, opening, 2).alias("rest"))
        return F.when(found != "", let(parts, lambda x: element_text(x["name"], x["rest"])))

    text = let(F.regexp_extract(html, opening, 0), inner)
    return let(prices.dollar_price(plain_text(text)), lambda p: F.when(~p.isin("", "0"), p))


def page_price(html: Column, text: Column) -> Column:
    """Price tag of the page, then its JSON-LD, then price elements, then any
    dollar amount.  A plain '0' is tried again on the whole text."""
    ld = F.regexp_extract(
        html, r"""(?is)<script\b[^>]*\btype\s*=\s*["']application/ld\+json["'][^>]*>(.*?)</script""", 1)
    stated = [
        filled(plain_text(_meta(html, "product:price:amount"))),
        filled(F.regexp_extract(ld, r'"price"\s*:\s*"?([0-9]+(?:\.[0-9]+)?)"?', 1))]
    found = F.coalesce(*stated, *[_shown_price(html, e) for e in _PRICE_ELEMENTS])
    return F.coalesce(let(found, lambda p: F.when(p != "0", p)), prices.dollar_price(text))


def was_fetched() -> Column:
    """Whether a page was captured with a status that is no error."""
    return F.coalesce((F.col("http_status") >= 100) & (F.col("http_status") < 400), F.lit(False))


def with_page_facts(pages: DataFrame) -> DataFrame:
    """What a captured page says by itself: its state (page, if there is none; feed; html),
    title, text and price.  Needs http_status, content_type, html."""
    fetched = was_fetched()
    feed = rules.is_feed(F.col("content_type"))
    rows = pages.withColumns({
        "_state": F.when(~fetched, "page").when(feed, "feed").otherwise("html"),
        "html": F.when(fetched & ~feed, blank(F.col("html"))).otherwise(""),
    })
    rows = with_page_text(with_page_title(rows, F.col("html")), text=F.col("html"))
    return rows.withColumn("price", page_price(F.col("html"), F.col("text"))).drop("html", "content_type")


def judged_products(rows: DataFrame) -> DataFrame:
    """Pages with their facts to products with a status: ok, skip or error.  Needs roaster,
    listing_url, product_url besides."""
    blocked = rules.is_blocked_for(F.col("roaster"), F.concat_ws(" ", "title", "product_url"), cleaned=True)
    rows = rows.withColumn("_state", F.when(
        (F.col("_state") == "html") & blocked, "blocked").otherwise(F.col("_state")))
    untitled = (F.col("_state") == "html") & (F.col("title") == "")
    status = (
        F.when(F.col("_state").isin("feed", "blocked"), "skip")
        .when((F.col("_state") == "page") | untitled, "error").otherwise("ok"))
    error = (
        F.when(F.col("_state") == "feed", "non_product_feed_page")
        .when(F.col("_state") == "blocked", "excluded_non_beans")
        .when(F.col("_state") == "page", F.concat(
            F.lit("product_page_error: "),
            F.coalesce(F.col("http_status").cast("string"), F.lit("not captured"))))
        .when(untitled, "missing_product_title").otherwise(""))
    rows = rows.withColumns({
        "status": status, "error": error, "body": F.col("text"),
        "source_url": F.when(F.col("_state") == "page", F.col("listing_url")).otherwise(F.col("product_url")),
    })
    return as_products(rows)


def page_products(pages: DataFrame) -> DataFrame:
    """Product pages to products with a status.

    Needs roaster, listing_url, product_url, http_status, content_type, html.
    """
    return judged_products(with_page_facts(pages))


# --- sources that follow links --------------------------------------------------------

LINKS = {
    "html_listing": ("listing_page", product_links),
    "shop_slug": ("shop_slug_listing", shop_links),
}


def listing_links(listings: DataFrame, strategy: str) -> DataFrame:
    """Product links of listing pages, in order.  Listings: roaster, listing_url,
    http_status, html.  Paths that the block list refuses go before any page is
    read (HTML listings); feed paths go (shop listings)."""
    _, links = LINKS[strategy]
    rows = unnest(
        listings.where(was_fetched()), links(F.col("listing_url"), F.col("html")),
        "ord", "product_url",
        *[c for c in listings.columns if c not in ("html", "http_status", "content_type")])
    path = url_path(F.col("product_url"))
    if strategy == "html_listing":
        return rows.where(~rules.is_blocked_for(F.col("roaster"), rules.path_words(path), cleaned=True))
    return rows.where(~F.contains(F.lower(path), F.lit("/feed")))


def discovered_handles(listings: DataFrame, count: int = V.HANDLE_LIMIT) -> DataFrame:
    """The collection handles of listing pages (roaster, listing_url, candidate_ord,
    http_status, html) that are worth a try, with their ``rank``: those that sound most like
    coffee first, shorter ones and then the first seen on ties."""
    rows = unnest(listings.where(was_fetched()), collection_handles(F.col("html")), "ord", "handle", "roaster", "listing_url", "candidate_ord")
    order = [handle_score(F.col("handle")).desc(), F.length("handle"), F.col("ord")]
    return top_per_group(rows, ["roaster", "candidate_ord"], order, count)


def discovery_reasons(listings: DataFrame) -> DataFrame:
    """Why listing pages gave no handles: (roaster, strategy, candidate_ord, reason, listing_url)."""
    reason = F.when(~was_fetched(), "handle_discovery_error").when(
        F.size(collection_handles(blank(F.col("html")))) == 0, "handle_discovery_no_candidates")
    return listings.select(
        "roaster", F.lit("discovered_collection").alias("strategy"), "candidate_ord", reason.alias("reason"), "listing_url"
    ).where("reason IS NOT NULL")


def linked_products(links: DataFrame, pages: DataFrame, strategy: str | None = None) -> DataFrame:
    """Products behind links; a page that was not captured gives an error row.
    Pages: url, http_status, content_type, html.  Links of several strategies, told apart by
    a column of that name, are best handed in together: a page is read once, whichever
    shops and strategies link it, and its facts go out to all its links.

    Pages are never handed to all executors: Spark takes a page for 20 bytes, whatever it
    holds, and would gather every one of them on the driver first.

    Skipped pages are still there: dropping them here would make Spark work out
    every page's status twice.  Write the table, then use ``not_skipped``.
    """
    if strategy is not None:
        links = links.withColumn("strategy", F.lit(strategy))
    wanted = links.select("product_url").distinct()
    pages = pages.withColumnRenamed("url", "product_url").hint("merge")
    facts = with_page_facts(wanted.join(pages, "product_url", "left"))
    # the facts lie by address already, so only the links are moved
    return judged_products(links.join(facts.hint("merge"), "product_url"))


def not_skipped(products: DataFrame) -> DataFrame:
    return products.where("status <> 'skip'")


def listing_reasons(listings: DataFrame, links: DataFrame, items: DataFrame, strategy: str) -> DataFrame:
    """Why a listing gave no valid items: (roaster, reason)."""
    name, _ = LINKS[strategy]
    linked = links.groupBy("roaster").agg(F.count("*").alias("n_links"))
    valid = items.groupBy("roaster").agg(F.count_if(F.col("status") == "ok").alias("n_ok"))
    rows = listings.select("roaster", "http_status").join(linked, "roaster", "left").join(
        valid, "roaster", "left")
    reason = (
        F.when(~was_fetched(), F.lit(
            "listing_page_error" if strategy == "html_listing" else "shop_slug_listing_error"))
        .when(F.coalesce("n_links", F.lit(0)) == 0, F.lit(f"{name}_no_product_links"))
        .when(F.coalesce("n_ok", F.lit(0)) == 0, F.lit(f"{name}_no_valid_products")))
    return rows.select("roaster", reason.alias("reason")).where("reason IS NOT NULL")


def sitemap_reasons(seeds: DataFrame, errors: DataFrame, found: DataFrame, items: DataFrame,
                    count: int | None = None) -> DataFrame:
    """Why the sitemaps of a site gave no valid items: (roaster, reason).  Seeds, errors
    and found (site, ...) are of ``crawl.expand_sitemaps``, items of the pages behind;
    with ``count`` only the first messages are told."""
    from shelf.operators.quality import joined_errors

    told = joined_errors(errors, ["site"], "ord", "error", count)
    linked = found.groupBy("site").agg(F.count("*").alias("n_links"))
    valid = items.groupBy(F.col("roaster").alias("site")).agg(F.count_if(F.col("status") == "ok").alias("n_ok"))
    rows = seeds.select("site").distinct().join(linked, "site", "left").join(valid, "site", "left").join(told.hint("merge"), "site", "left")
    detail = F.coalesce(F.concat(F.lit(": "), "errors"), F.lit(""))
    reason = (
        F.when(F.col("n_links").isNull(), F.lit("sitemap_no_product_urls"))
        .when(F.coalesce("n_ok", F.lit(0)) == 0, F.concat(F.lit("sitemap_no_valid_products"), detail)))
    return rows.select(F.col("site").alias("roaster"), reason.alias("reason")).where("reason IS NOT NULL")


def sitemap_links(products: DataFrame, max_urls: int | None = None) -> DataFrame:
    """The product addresses of every site, or the first ``max_urls`` found."""
    if max_urls is None:
        return products
    return top_per_group(
        products, ["site"], [F.col("ord"), F.col("pos")], max_urls, rank="place").drop("place")
