"""Bilingual values, levels, dates and cover images of diary entries.

A localised value is a ``map<string,string>``; a plain string is read as both
languages (see ``localised``).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from shelf import vocabulary as V
from shelf.functions.text import blank, filled

LANGUAGES = ("zh", "en")


def localised(raw: Column) -> Column:
    """A localised value, read as VARIANT, to a map: an object as it is, a string for
    both languages, and nothing for a null or any other kind of value."""
    kind = F.schema_of_variant(raw)
    plain = F.when(kind == "STRING", F.try_variant_get(raw, "$", "string"))
    return F.when(plain.isNotNull(), F.create_map(F.lit("en"), plain, F.lit("zh"), plain)).when(
        kind.startswith("OBJECT"), F.try_variant_get(raw, "$", "map<string,string>"))


def in_language(value: Column, lang: Column | str) -> Column:
    """The asked language, else English, else Chinese, else ''; blank counts as missing."""
    lang = F.lit(lang) if isinstance(lang, str) else lang
    return F.coalesce(
        filled(F.try_element_at(value, lang)), filled(F.try_element_at(value, F.lit("en"))),
        filled(F.try_element_at(value, F.lit("zh"))), F.lit(""))


def level_index(level: Column) -> Column:
    """low 0, medium 1, high 2, anything else 0."""
    levels = F.array(*[F.lit(x) for x in V.TASTE_LEVELS])
    return F.greatest(F.coalesce(F.array_position(levels, level), F.lit(0)) - 1, F.lit(0)).cast("int")


def level_percent(level: Column) -> Column:
    return level_index(level) * 50


def level_rows(profile: Column) -> Column:
    """Array of (ord, dim, level, percent) of the dimensions an entry has, in fixed order."""
    rows = [
        F.struct(F.lit(i).alias("ord"), F.lit(d).alias("dim"), profile[d].alias("level"),
                 level_percent(profile[d]).alias("percent"))
        for i, d in enumerate(V.TASTE_DIMS)
    ]
    return F.filter(F.array(*rows), lambda r: blank(r.level) != "")


def images_of(images: Column, image: Column) -> Column:
    none = F.array().cast("array<string>")
    return F.when(F.size(images) > 0, images).when(blank(image) != "", F.array(image)).otherwise(none)


def cover_of(images: Column, image: Column) -> Column:
    return F.when(F.size(images) > 0, F.try_element_at(images, F.lit(1))).otherwise(image)


def first_chips(flavours: Column, count: int = 3) -> Column:
    return F.slice(flavours, 1, count)


def month_key(date: Column) -> Column:
    return F.substring(blank(date.cast("string")), 1, 7)


def month_label(month: Column, lang: str = "en", short: bool = False) -> Column:
    """'July 2026' / 'Jul 2026' / '2026年7月'; a blank month is a dash."""
    start = F.try_to_timestamp(F.concat(month, F.lit("-01")), F.lit("yyyy-MM-dd"))
    year, number = F.year(start).cast("string"), F.month(start).cast("string")
    label = (
        F.date_format(start, "MMM yyyy" if short else "MMMM yyyy") if lang == "en"
        else F.concat(year, F.lit("年"), number, F.lit("月"))
    )
    return F.coalesce(label, filled(month), F.lit("—"))


def long_date(date: Column, lang: str = "en") -> Column:
    day = F.try_to_timestamp(date, F.lit("yyyy-MM-dd"))
    label = (
        F.date_format(day, "d MMMM yyyy") if lang == "en"
        else F.concat(F.year(day).cast("string"), F.lit("年"), F.month(day).cast("string"),
                      F.lit("月"), F.dayofmonth(day).cast("string"), F.lit("日"))
    )
    return F.coalesce(label, date)


def theme_of(colour: Column) -> Column:
    """Page theme of a colour name, with a default."""
    pairs = [F.lit(x) for kv in V.THEMES.items() for x in kv]
    return F.coalesce(F.create_map(*pairs)[colour], F.lit(V.THEMES[V.DEFAULT_THEME]))


def spec_rows(details: Column, lang: str = "en") -> Column:
    """Array of (ord, label, value) of the filled details in fixed order."""
    rows = []
    for i, name in enumerate(V.SPEC_ORDER):
        value = details[name]
        if name in ("varietal", "process"):
            value = in_language(value, lang)
        rows.append(F.struct(F.lit(i).alias("ord"), F.lit(name).alias("label"), value.alias("value")))
    return F.filter(F.array(*rows), lambda r: blank(r.value) != "")


def paragraphs(story: Column) -> Column:
    """A story split at blank lines; no story gives no paragraph."""
    return F.when(story != "", F.split(story, "\n\n", -1)).otherwise(F.array().cast("array<string>"))


def search_text(*parts: Column) -> Column:
    """Lower-case search text of strings and of maps (both languages)."""
    return F.lower(F.concat_ws(" ", *parts))


def both_languages(value: Column) -> Column:
    """The filled texts of a localised value, Chinese first."""
    return F.array_compact(F.array(*[filled(F.try_element_at(value, F.lit(x))) for x in LANGUAGES]))
