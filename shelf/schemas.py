"""Schemas of the inputs and of the catalogue item, as DDL."""

from __future__ import annotations

ITEM_COLUMNS = [
    "roaster", "source_url", "bean_name", "roast_profile", "origin", "price_aud", "process",
    "varietal", "flavour_profile", "product_url", "status", "error",
]
ITEM = ", ".join(f"{c} STRING" for c in ITEM_COLUMNS)

CONFIG = (
    "name STRING, url STRING, collection_url_override STRING, shopify_collection_handle STRING, "
    "price_variant_filter STRING, force_html_listing BOOLEAN, force_woo_api BOOLEAN, "
    "field_rules STRUCT<skip_sources: ARRAY<STRING>, tag_aliases: MAP<STRING, ARRAY<STRING>>>"
)

# captured payloads: what a fetch brought in, one row per request
PAYLOAD = (
    "roaster STRING, strategy STRING, candidate_ord INT, page INT, listing_url STRING, url STRING, "
    "http_status INT, content_type STRING, body STRING"
)

COLLECTION = (
    "STRUCT<products: ARRAY<STRUCT<title: STRING, handle: STRING, tags: ARRAY<STRING>, "
    "body_html: STRING, variants: ARRAY<STRUCT<title: STRING, price: STRING, available: BOOLEAN>>>>>"
)
DETAIL = (
    "STRUCT<product: STRUCT<variants: ARRAY<STRUCT<title: STRING, price: STRING, "
    "price_currency: STRING, inventory_management: STRING, inventory_policy: STRING, "
    "inventory_quantity: INT>>>>"
)
WOO = (
    "ARRAY<STRUCT<name: STRING, permalink: STRING, is_in_stock: BOOLEAN, short_description: STRING, "
    "description: STRING, categories: ARRAY<STRUCT<name: STRING>>, tags: ARRAY<STRUCT<name: STRING>>, "
    "prices: STRUCT<price: STRING, currency_minor_unit: INT>>>"
)
WORDPRESS = (
    "ARRAY<STRUCT<title: STRUCT<rendered: STRING>, link: STRING, excerpt: STRUCT<rendered: STRING>, "
    "content: STRUCT<rendered: STRING>>>"
)

_ITEM_STRUCT = "STRUCT<" + ", ".join(f"{c}: STRING" for c in ITEM_COLUMNS) + ">"
SNAPSHOT = (
    "generated_at STRING, summary STRUCT<total_rows: INT, ok_rows: INT, error_rows: INT>, "
    f"items ARRAY<{_ITEM_STRUCT}>"
)

_LS = "MAP<STRING, STRING>"
DIARY_ENTRY = (
    f"slug STRING, date STRING, roast_date STRING, bean_name {_LS}, roaster {_LS}, image STRING, "
    "images ARRAY<STRING>, color STRING, roast_profile STRING, price_aud STRING, weight STRING, "
    f"url STRING, tags ARRAY<{_LS}>, flavours ARRAY<STRUCT<icon: STRING, label: {_LS}>>, story {_LS}, "
    f"brew STRUCT<method: {_LS}>, profile STRUCT<acidity: STRING, sweetness: STRING, body: STRING, "
    f"aroma: STRING, aftertaste: STRING>, summary {_LS}, details STRUCT<producer: STRING, "
    f"farm: STRING, region: {_LS}, altitude: STRING, varietal: {_LS}, process: {_LS}, notes: {_LS}, "
    "flag: STRING, map_url: STRING>"
)
FAVOURITES = "items MAP<STRING, STRING>, tombstones MAP<STRING, DOUBLE>, updated_at BIGINT"
