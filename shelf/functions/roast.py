"""Roast profile from titles, variants, tags, categories and text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from shelf import vocabulary as V
from shelf.functions.fields import squeeze_edges
from shelf.functions.text import blank, filled, let


def _decide(omni: Column, as_filter: Column, as_espresso: Column) -> Column:
    return (
        F.when(omni | (as_filter & as_espresso), "omni")
        .when(as_filter, "filter")
        .when(as_espresso, "espresso")
        .otherwise("")
    )


def _says(c: Column, *names: str) -> Column:
    return c.rlike(r"(?iU)\b(?:" + "|".join(names) + r")\b")


def roast_of_title(title: Column) -> Column:
    return _decide(_says(title, "omni"), _says(title, "filter"), _says(title, "espresso"))


def roast_of_text(text: Column) -> Column:
    return _decide(
        _says(text, r"omni(?:\s*roast)?"), _says(text, *V.FILTER_WORDS), _says(text, "espresso"))


def tag_roasts(tags: Column) -> Column:
    """Roast values in tags.  The last 'Coffee Type' with a known roast stands
    alone; else every 'Roast: …' value and every known 'Brew Method'."""
    tags = F.transform(F.coalesce(tags, F.array().cast("array<string>")), squeeze_edges)

    def type_of(tag):
        value = F.regexp_extract(tag, r"(?id)^Coffee\s+Type[.\s]+(.+)$", 1)
        return F.when(_says(value, "filter"), "filter").when(_says(value, "espresso"), "espresso")

    def roast_of(tag):
        brew = F.regexp_extract(tag, r"(?id)^Brew\s+Method[.\s]+(.+)$", 1)
        given = F.regexp_extract(tag, r"(?id)^ROAST\s*:\s*(.+)$", 1)
        return (
            F.when(given != "", given)
            .when(brew.rlike("(?iU)" + V.BREW_TAG_FILTER), "filter")
            .when(_says(brew, "espresso"), "espresso")
        )

    last_type = F.try_element_at(F.array_compact(F.transform(tags, type_of)), F.lit(-1))
    return F.when(last_type.isNotNull(), F.array(last_type)).otherwise(
        F.array_compact(F.transform(tags, roast_of)))


def listed_roast(title: Column, variant_titles: Column, tags: Column) -> Column:
    """Title, then variants that show both ways of brewing, then tags; NULL if
    none of them decides and the text has to."""
    joined = F.lower(F.array_join(F.transform(variant_titles, blank), " "))
    both = F.contains(joined, F.lit("espresso")) & joined.rlike("|".join(V.FILTER_VARIANT_WORDS))
    of_tags = let(
        tag_roasts(tags),
        lambda r: F.when(F.size(r) > 0, roast_of_text(F.array_join(r, " "))),
    )
    return F.coalesce(
        filled(roast_of_title(title)),
        F.when(F.coalesce(both, F.lit(False)), F.lit("omni")),
        of_tags,
    )


def category_roast(espresso_seen: Column, filter_seen: Column) -> Column:
    """What the categories of a title group say; NULL leaves it to the text."""
    return filled(_decide(F.lit(False), filter_seen, espresso_seen))


def roast_bucket(profile: Column) -> Column:
    return F.when(profile.isin(V.ROASTS), profile).otherwise("unknown")


def roast_colour(profile: Column) -> Column:
    pairs = [F.lit(x) for kv in V.ROAST_COLOURS.items() for x in kv]
    return blank(F.create_map(*pairs)[profile])
