"""Products of any source to catalogue items: fields and roast, read once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelf import schemas
from shelf.functions.fields import with_fields
from shelf.functions.roast import roast_of_text

# what a source reader hands on; ``body`` is labelled text, ``text`` all text,
# ``shown_roast`` a roast that decides before the text does
PRODUCT = {
    "roaster": "string", "strategy": "string", "candidate_ord": "int", "ord": "bigint", "title": "string",
    "source_url": "string", "product_url": "string", "tags": "array<string>", "body": "string",
    "text": "string", "price": "string", "shown_roast": "string", "skip_sources": "array<string>",
    "tag_aliases": "map<string,array<string>>", "status": "string", "error": "string",
}


def as_products(rows: DataFrame, **given: Column | None) -> DataFrame:
    """The product columns: given ones, those at hand, else a default."""
    defaults = {"source_url": F.col("product_url"), "status": F.lit("ok"), "error": F.lit("")}
    defaults = {c: v for c, v in defaults.items() if c not in rows.columns}
    columns = {**defaults, **{c: v for c, v in given.items() if v is not None}}

    def column(name, kind):
        if name in columns:
            return columns[name]
        return F.col(name) if name in rows.columns else F.lit(None).cast(kind)

    return rows.select(*[column(c, t).cast(t).alias(c) for c, t in PRODUCT.items()])


def items(products: DataFrame, keep=("strategy", "candidate_ord", "ord")) -> DataFrame:
    """Catalogue items.  Products that were refused carry no fields.  ``refused``, beside
    the item, holds values that the fields' guards did not take.

    This is the costly step, so choose between sources before it.
    """
    usable = F.col("status") == "ok"
    usable = usable | (F.col("error") == "missing_product_title")
    rows = with_fields(
        products, text="text", body="body", tags="tags", title="title", url="product_url",
        skip="skip_sources", aliases="tag_aliases")
    roast = F.coalesce("shown_roast", roast_of_text(F.col("text")))
    only = lambda c: F.when(usable, c).otherwise("")
    given = {
        "bean_name": F.col("title"), "price_aud": F.col("price"), "roast_profile": only(roast),
        **{c: only(F.col(c)) for c in ("origin", "process", "varietal", "flavour_profile")},
    }
    refused = F.when(usable, F.col("refused"))
    return rows.select(*keep, *[given.get(c, F.col(c)).alias(c) for c in schemas.ITEM_COLUMNS], refused.alias("refused"))
