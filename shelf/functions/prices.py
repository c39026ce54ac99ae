"""Prices and stock of variants.

``variants`` is an array of structs with ``title`` and ``price`` (text) and,
by source, ``available``, ``price_currency`` or the three inventory members.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from shelf.functions.text import blank, filled, let

MONEY = "decimal(38,2)"


def money_text(c: Column) -> Column:
    """Two decimals, halves up; NULL if it has too many digits."""
    return c.try_cast(MONEY).cast("string")


def dollar_price(text: Column) -> Column:
    """The first ``$ 12.34`` in a text."""
    return F.regexp_extract(text, r"\$\s*([0-9]+(?:\.[0-9]{1,2})?)", 1)


def of_size(variants: Column, size: Column) -> Column:
    """Variants whose title holds the size, or all if none does."""
    wanted = F.filter(
        variants,
        lambda v: F.coalesce(
            (blank(size) != "") & F.contains(F.lower(blank(v.title)), F.lower(size)), F.lit(False)),
    )
    return let(wanted, lambda w: F.when(F.size(w) > 0, w).otherwise(variants))


def variant_price(variants: Column, size: Column) -> Column:
    """Lowest price among the variants of the size; the first raw price if any
    of them is no number; '' without a price."""
    def lowest(chosen):
        given = F.filter(F.transform(chosen, lambda v: v.price), lambda p: p.isNotNull())
        numbers = F.transform(given, lambda p: p.try_cast("decimal(38,6)"))
        bad = F.exists(numbers, lambda n: n.isNull())
        first = blank(F.try_element_at(variants, F.lit(1)).price)
        return F.when(bad, first).otherwise(blank(money_text(F.array_min(numbers))))

    return F.coalesce(let(of_size(variants, size), lowest), F.lit(""))


def detail_price(variants: Column, size: Column, base: Column) -> Column:
    """The detail price where the first variant is in AUD, else the listed one."""
    def lowest(chosen):
        given = F.filter(F.transform(chosen, lambda v: filled(v.price)), lambda p: p.isNotNull())
        numbers = F.transform(given, lambda p: p.try_cast("decimal(38,6)"))
        return F.when(~F.exists(numbers, lambda n: n.isNull()), money_text(F.array_min(numbers)))

    aud = F.try_element_at(variants, F.lit(1)).price_currency == "AUD"
    return F.coalesce(F.when(aud, let(of_size(variants, size), lowest)), base)


#: Beyond so many places a unit moves every amount that fits into a decimal out of it.
_PLACES = 38


def minor_unit_price(raw: Column, minor: Column) -> Column:
    """Digits in minor units to two decimals, halves up; '' if not all digits.

    Amounts of up to 18 digits with units from 0 to 18 are decimals.  Others have the point
    moved in the text, so digits of any number do; amounts beyond 38 digits are given
    without the rounding.  A unit that leaves nothing of the digits gives 0.00; negative units
    multiply, by up to 38 places, and beyond give ''.
    """
    raw, unit = F.btrim(blank(raw)), F.coalesce(minor, F.lit(2)).cast("long")
    ten = F.element_at(F.array(*[F.lit("1" + "0" * k).cast("decimal(20,0)") for k in range(19)]), unit.cast("int") + 1)
    short = (raw.try_cast("decimal(18,0)") / ten).cast(MONEY).cast("string")
    easy = (F.length(raw) <= 18) & unit.between(0, 18)
    # bound once: the steps below use them many times
    odd = F.struct(raw.alias("raw"), F.least(unit, F.length(raw) + 3).cast("int").alias("unit"))
    return F.when(~raw.rlike("^[0-9]+$"), "").when(easy, short).when(unit < -_PLACES, "").otherwise(
        let(odd, lambda x: _moved_point(x.raw, x.unit)))


def _moved_point(raw: Column, unit: Column) -> Column:
    places = F.greatest(unit, F.lit(0))
    padded = F.concat(raw, F.repeat(F.lit("0"), F.greatest(-unit, F.lit(0))))
    digits = let(padded, lambda d: F.lpad(d, F.greatest(F.length(d), unit + 1), "0"))

    def parts(d):
        whole = F.regexp_replace(F.substr(d, F.lit(1), F.length(d) - places), "^0+(?=.)", "")
        rest = F.rpad(F.substr(d, F.length(d) - places + 1), F.greatest(places, F.lit(3)), "0")
        return F.struct(whole.alias("whole"), rest.alias("rest"))

    def rounded(p):
        down = F.concat(p.whole, F.lit("."), F.substring(p.rest, 1, 2))
        more = (down.try_cast(MONEY) + F.lit("0.01").cast("decimal(3,2)")).try_cast(MONEY).cast("string")
        return F.when(F.substring(p.rest, 3, 1) >= "5", F.coalesce(more, down)).otherwise(down)

    return let(let(digits, parts), rounded)


def sold_out(variants: Column) -> Column:
    """There are variants and each says in so many words it is unavailable."""
    return F.coalesce(
        (F.size(variants) > 0) & F.forall(variants, lambda v: v.available.eqNullSafe(False)),
        F.lit(False),
    )


def out_of_stock(variants: Column) -> Column:
    """There are variants and each is tracked, not to be oversold, and at zero."""
    return F.coalesce(
        (F.size(variants) > 0) & F.forall(
            variants,
            lambda v: v.inventory_management.eqNullSafe("shopify")
            & v.inventory_policy.eqNullSafe("deny")
            & (F.coalesce(v.inventory_quantity, F.lit(0)) <= 0),
        ),
        F.lit(False),
    )
