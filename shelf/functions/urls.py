"""Addresses: parts, resolving, product links, shop links, candidates to fetch."""

from __future__ import annotations

import functools
import operator

from pyspark.sql import Column
from pyspark.sql import functions as F

from shelf import vocabulary as V
from shelf.functions.text import blank, filled, let, unescape_all, unescape_slashes

_SCHEME = r"^([A-Za-z][A-Za-z0-9+.\-]*):"
_AUTHORITY = r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//([^/?#]*)"
_PATH = r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?(?://[^/?#]*)?([^?#]*)"


def url_scheme(u: Column) -> Column:
    return F.lower(F.regexp_extract(u, _SCHEME, 1))


def url_authority(u: Column) -> Column:
    return F.regexp_extract(u, _AUTHORITY, 1)


def url_path(u: Column) -> Column:
    """Path without query, fragment and the ';…' of the last segment."""
    return F.regexp_replace(F.regexp_extract(blank(u), _PATH, 1), ";[^/]*$", "")


def site_root(u: Column) -> Column:
    return F.concat(url_scheme(u), F.lit("://"), url_authority(u))


def site_host(u: Column) -> Column:
    """Host and port in lower case without a leading 'www.'."""
    return F.regexp_replace(F.btrim(F.lower(url_authority(u))), r"^www\.", "")


def same_site(a: Column, b: Column) -> Column:
    return site_host(a) == site_host(b)


def other_www(u: Column) -> Column:
    """The address with 'www.' taken off or put on; NULL without a host."""
    host = url_authority(u)
    return (
        F.when(host == "", F.lit(None).cast("string"))
        .when(host.startswith("www."), F.regexp_replace(u, r"//www\.", "//"))
        .otherwise(F.regexp_replace(u, "^([^/]*//)", "$1www."))
    )


def _without_dots(path: Column) -> Column:
    """Resolve '.' and '..' segments."""
    def step(kept, segment):
        return (
            F.when(segment == ".", kept)
            .when(segment == "..", F.slice(kept, F.lit(1), F.greatest(F.size(kept) - 1, F.lit(1))))
            .otherwise(F.array_append(kept, segment))
        )

    walked = F.aggregate(
        F.split(F.regexp_replace(path, r"/\.{1,2}$", "$0/"), "/", -1),
        F.array().cast("array<string>"), step,
    )
    return F.when(path.rlike(r"/\.{1,2}(?:/|$)"), F.array_join(walked, "/")).otherwise(path)


def base_parts(base: Column) -> Column:
    """What resolving needs of the page's own address, worked out once per page."""
    path = url_path(base)
    folder = F.coalesce(filled(F.regexp_extract(path, "^.*/", 0)), F.lit("/"))
    return F.struct(
        base.alias("whole"), url_scheme(base).alias("scheme"), site_root(base).alias("root"),
        path.alias("path"), folder.alias("folder"), site_host(base).alias("host"))


def resolve(base: Column, ref: Column) -> Column:
    """Absolute form of a link found on a page; ``base`` are its ``base_parts``."""
    place = F.regexp_extract(ref, "^[^?#]*", 0)
    return (
        F.when(ref.rlike(_SCHEME), ref)
        .when(ref.startswith("//"), F.concat(base.scheme, F.lit(":"), ref))
        .when(ref == "", base.whole)
        .when(ref.rlike("^[?#]"), F.concat(base.root, base.path, ref))
        .otherwise(F.concat(
            base.root,
            _without_dots(F.when(ref.startswith("/"), place).otherwise(F.concat(base.folder, place))),
            F.regexp_extract(ref, "[?#].*$", 0),
        ))
    )


def product_url(base: Column, ref: Column, markers=tuple(V.PRODUCT_PATHS)) -> Column:
    """Resolved link without query and fragment; NULL if it is no product path."""
    def tidy(full):
        path = url_path(full)
        wanted = F.lit(False)
        for marker in markers:
            wanted = wanted | F.contains(path, F.lit(marker))
        return F.when(wanted, F.concat(site_root(full), path))

    return let(resolve(base, F.btrim(ref)), tidy)


def _addresses(base: Column, refs: Column, to_url) -> Column:
    """Distinct addresses of distinct links, first seen first."""
    # the links are bound from outside, as a lambda's body may not hold what goes through Arrow
    both = F.struct(base_parts(base).alias("base"), F.array_distinct(refs).alias("refs"))
    found = let(both, lambda x: F.transform(x.refs, lambda r: to_url(x.base, r)))
    return F.array_distinct(F.array_compact(found))


# --- links of a page -------------------------------------------------------------

def _all(c: Column, pattern: str, group: int) -> Column:
    return F.regexp_extract_all(c, F.lit(pattern), F.lit(group))


# an attribute's value: in either kind of quotes, or up to the next blank
_VALUE = r""""[^"]*"|'[^']*'|[^\s"'=<>`]+"""


def _anchors(html: Column) -> Column:
    return _unquoted(_all(html, rf"""(?is)<a\b[^>]*?\shref\s*=\s*({_VALUE})""", 1))


def _unquoted(values: Column) -> Column:
    return F.transform(values, lambda v: F.regexp_replace(v, r"""(?s)\A(["'])(.*)\1\z""", "$2"))


def _decoded(refs: Column) -> Column:
    """Distinct links with their entities decoded, once.  Plain ones are decoded by
    expressions, '&amp;' last, so that it starts no other; rows with any other entity go
    through Arrow."""
    plain = "|".join(V.LINK_ENTITIES)
    rare = rf"&(?!(?:amp|{plain});)(?:#[0-9]+|#[xX][0-9A-Fa-f]+|[A-Za-z][A-Za-z0-9]*);"

    def decode(r):
        for name, char in V.LINK_ENTITIES.items():
            r = F.replace(r, F.lit(f"&{name};"), F.lit(char))
        return F.replace(r, F.lit("&amp;"), F.lit("&"))

    refs = F.array_distinct(refs)
    some = unescape_all(let(refs, lambda x: F.when(F.exists(x, lambda r: r.rlike(rare)), x)))
    return F.coalesce(some, F.transform(refs, lambda r: F.when(F.contains(r, F.lit("&")), decode(r)).otherwise(r)))


def product_links(base: Column, html: Column, markers=tuple(V.PRODUCT_PATHS)) -> Column:
    """Product addresses of a page, first seen first: anchors, link attributes,
    quoted paths and full addresses in scripts, the latter two unescaped as well."""
    attributes = _unquoted(_all(
        html, rf"""(?is)\s(?:data-product-url|data-url|data-href|href)\s*=\s*({_VALUE})""", 1))
    attributes = F.filter(attributes, lambda r: r.rlike("/products?/"))

    def blob(text):
        return F.concat(
            _all(text, r"""["'](/products?/[^"']+)["']""", 1),
            _all(text, r"""(https?://[^"'>\s]+/products?/[^"'>\s]+)""", 1),
        )

    found = _decoded(F.concat(_anchors(html), attributes, blob(html), blob(unescape_slashes(html))))
    return _addresses(base, found, lambda b, r: product_url(b, r, markers))


def shop_links(base: Column, html: Column) -> Column:
    """``/shop/<slug>`` and ``/shop/<category>/<slug>`` addresses of the same site."""
    def blob(text):
        return F.concat(
            _all(text, r"""(https?://[^"'>\s]+/shop/[^"'>\s]+)""", 1),
            _all(text, r"""["'](/shop/[^"']+)["']""", 1),
        )

    def shop_url(b, ref):
        def tidy(full):
            slug = F.regexp_extract(
                F.rtrim(url_path(full), F.lit("/")), "^/shop/((?:[^/]+/)?[^/]+)$", 1)
            first = F.lower(F.substring_index(slug, "/", 1))
            keep = (b.host == site_host(full)) & (slug != "") & ~first.isin(V.SHOP_SLUG_STOPS)
            return F.when(keep, F.concat(b.root, F.lit("/shop/"), slug))

        return let(resolve(b, F.btrim(ref)), tidy)

    found = _decoded(F.concat(blob(html), blob(unescape_slashes(html)), _anchors(html)))
    return _addresses(base, found, shop_url)


def collection_handles(html: Column) -> Column:
    """Distinct collection handles of a page, first seen first."""
    raw = _all(html, V.HANDLE_PATTERN, 1)
    handles = F.transform(raw, lambda h: F.btrim(F.lower(h), F.lit("-")))
    return F.array_distinct(F.filter(handles, lambda h: (h != "") & ~h.isin(V.HANDLE_DROPS)))


def handle_score(handle: Column) -> Column:
    """How much a handle sounds like coffee."""
    def has(parts):
        return functools.reduce(operator.or_, [F.contains(handle, F.lit(p)) for p in parts]).cast("int")

    return functools.reduce(operator.add, [has(parts) * more for parts, more in V.HANDLE_SCORES])


# --- what to fetch for a shop -------------------------------------------------------

def collection_json_url(listing: Column, handle: Column | None = None) -> Column:
    """Feed address of a collection, from a given handle or from the listing path."""
    from_path = filled(F.regexp_extract(url_path(listing), "^/*collections/+([^/]+)", 1))
    own = filled(F.btrim(blank(handle), F.lit("/"))) if handle is not None else None
    chosen = F.coalesce(own, from_path) if own is not None else from_path
    return F.concat(site_root(listing), F.lit("/collections/"), chosen, F.lit("/" + V.COLLECTION_QUERY))


def fetch_candidates(listing: Column, handle: Column | None = None) -> Column:
    """Ordered array of (strategy, url) for a shop on one host variant."""
    root = site_root(listing)

    def row(strategy, url):
        return F.struct(F.lit(strategy).alias("strategy"), url.alias("url"))

    rows = [row("collection", collection_json_url(listing, handle)), row("html_listing", listing)]
    rows += [
        row("all_products", F.concat(root, F.lit(f"{prefix}/{V.COLLECTION_QUERY}")))
        for prefix in V.ALL_PRODUCT_PREFIXES
    ]
    rows += [row("sitemap", F.concat(root, F.lit(f"/{name}"))) for name in V.SITEMAP_FILES]
    rows += [
        row("woo", F.concat(root, F.lit("/wp-json/wc/store/v1/products"))),
        row("wordpress", F.concat(root, F.lit("/wp-json/wp/v2/product"))),
    ]
    return F.filter(F.array(*rows), lambda r: r.url.isNotNull())
