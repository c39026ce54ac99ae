"""Fields from tags, from labelled text and from free text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelf import vocabulary as V
from shelf.functions.guards import GUARDS, accept
from shelf.functions.text import blank, cut, filled, let, squeeze, words
from shelf.functions.urls import url_path

_TAG = r"(?d)^\s*([A-Za-z][A-Za-z /]*?)\s*[:._]\s*(.+)$"
_PLACEHOLDER = "^[A-Z][A-Z0-9 /]+$"


# --- tags ---------------------------------------------------------------------

def alias_pairs(aliases: Column) -> Column:
    """``{field: [key, …]}`` of a shop's rules as an array of (key, field)."""
    pairs = F.transform(
        F.map_entries(aliases),
        lambda e: F.transform(
            e.value, lambda k: F.struct(F.lower(F.trim(k)).alias("key"), e.key.alias("field"))
        ),
    )
    return F.flatten(pairs)


def tag_fields(tags: Column, aliases: Column | None = None) -> Column:
    """Struct of the four fields from ``KEY: v`` / ``KEY_v`` / ``Key.v`` tags."""
    lookup = F.create_map(*[F.lit(x) for kv in V.TAG_KEYS.items() for x in kv])
    pairs = alias_pairs(aliases) if aliases is not None else None

    def parse(tag):
        tag = squeeze_edges(tag)
        key = squeeze(F.lower(F.regexp_extract(tag, _TAG, 1)))
        return F.struct(key.alias("key"), squeeze_edges(F.regexp_extract(tag, _TAG, 2)).alias("value"))

    def named(entry):
        field = lookup[entry.key]
        if pairs is not None:
            own = F.try_element_at(F.filter(pairs, lambda p: p.key == entry.key), F.lit(-1))
            field = F.coalesce(own.field, field)
        return F.struct(field.alias("field"), entry.value.alias("value"))

    def pick(entries):
        return F.struct(*[
            F.array_join(
                F.array_distinct(F.transform(
                    F.filter(
                        entries,
                        lambda e: (e.field == f) & (e.value != "") & ~e.value.rlike(_PLACEHOLDER),
                    ),
                    lambda e: e.value,
                )), ", ",
            ).alias(f)
            for f in V.FIELDS
        ])

    entries = F.transform(F.transform(F.coalesce(tags, F.array().cast("array<string>")), parse), named)
    return let(entries, pick)


def squeeze_edges(c: Column) -> Column:
    """Trim white space of any kind."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+\z", "")


# --- labelled text -------------------------------------------------------------

_MARK, _SEP = "\u0001", "\u0002"
_LABEL = r"(?iU)\b(" + "|".join(p for p, _ in V.BODY_LABELS) + r")\b\s*[:\-]\s*"


def label_fields(text: Column) -> Column:
    """Struct of the four fields from ``Label: value`` text.

    Every label ends the value before it.  Labels are marked in one pass, the
    text is split at the marks, and each field takes its first non-empty value.
    """
    flat = squeeze(F.translate(blank(text), _MARK + _SEP, "  "))
    marked = F.regexp_replace(flat, _LABEL, f"{_MARK}$1{_SEP}")
    pieces = F.filter(F.split(marked, _MARK), lambda p: F.contains(p, F.lit(_SEP)))

    def value_of(piece):
        value = F.substring_index(piece, _SEP, -1)
        value = cut(F.btrim(value, F.lit(" ,;:-")), "[.;]", "s")
        return F.btrim(value)

    def pick(found):
        out = []
        for field in V.FIELDS:
            labels = "|".join(p for p, f in V.BODY_LABELS if f == field)
            # '\\S' after the separator leaves out empty values before any work
            own = F.filter(found, lambda p: p.rlike(rf"(?iU)^(?:{labels}){_SEP}"))
            values = F.filter(F.transform(own, value_of), lambda v: v != "")
            out.append(blank(F.try_element_at(values, F.lit(1))).alias(field))
        return F.struct(*out)

    return let(pieces, pick)


# --- both ------------------------------------------------------------------------

def raw_fields(tags: Column | None, body: Column | None, skip: Column | None = None,
               aliases: Column | None = None) -> Column:
    """Tag value, else body value, per field, before any guard."""
    def source(name, fields):
        if skip is None:
            return fields
        return F.when(~F.coalesce(F.array_contains(skip, name), F.lit(False)), fields)

    tag = source("tags", tag_fields(tags, aliases)) if tags is not None else None
    label = source("body", label_fields(body)) if body is not None else None
    given = [s for s in (tag, label) if s is not None]
    return let(
        F.struct(*[g.alias(f"s{i}") for i, g in enumerate(given)]),
        lambda s: F.struct(*[
            F.coalesce(*[filled(s[f"s{i}"][f]) for i in range(len(given))], F.lit("")).alias(f)
            for f in V.FIELDS
        ]),
    )


def guard_fields(raw: Column) -> Column:
    return F.struct(*[GUARDS[f](raw[f]).alias(f) for f in V.FIELDS])


# --- free text --------------------------------------------------------------------

def _captured(text: Column, pattern: str, stops: str) -> Column:
    """Group 1 of the pattern, cut at the stops; NULL if the pattern is not there."""
    found = squeeze(filled(F.regexp_extract(text, "(?iU)" + pattern, 1)))
    return F.btrim(cut(found, stops), F.lit(" ,"))


def origin_from_text(text: Column) -> Column:
    """Label, else 'from …' with a country in it, else the countries named."""
    labelled, grown = _captured(text, *V.ORIGIN_LABEL), _captured(text, *V.ORIGIN_PHRASE)
    grown = F.regexp_extract(grown, "(?is)^.*(?:" + "|".join(V.COUNTRIES) + r").*\z", 0)
    titles = sorted((c.upper() if c == "png" else c.title(), c) for c in V.COUNTRIES)
    named = let(F.lower(text), lambda low: F.concat_ws(
        ", ", *[F.when(F.contains(low, F.lit(c)), F.lit(t)) for t, c in titles]))
    return F.coalesce(labelled, filled(grown), named)


_TERM = r"(?iU)\b(" + "|".join(p for p, _ in V.PROCESS_TERMS) + r")\b"


def _process_terms(text: Column) -> Column:
    """Labels of the terms in the text, in list order; NULL if there are none."""
    def listed(seen):
        return F.concat_ws(", ", *[
            F.when(F.exists(seen, lambda t: t.rlike(rf"(?iU)^{p}\z")), F.lit(label))
            for p, label in V.PROCESS_TERMS])

    found = F.array_distinct(F.regexp_extract_all(text, F.lit(_TERM), F.lit(1)))
    return let(found, lambda seen: F.when(F.size(seen) > 0, listed(seen)))


def process_from_text(text: Column, title: Column | None = None, url: Column | None = None) -> Column:
    """Label, else terms of the title, of the address, of the text."""
    tries = [_captured(text, *V.PROCESS_LABEL)]
    if title is not None:
        tries.append(_process_terms(title))
    if url is not None:
        tries.append(_process_terms(F.translate(url_path(url), "-", " ")))
    return F.coalesce(*tries, _process_terms(text), F.lit(""))


def varietal_from_text(text: Column) -> Column:
    return blank(_captured(text, *V.VARIETAL_LABEL))


def _note_candidate(raw: Column) -> Column:
    c = squeeze(raw)
    stops = r"(?:" + "|".join(V.NOTE_STOPS) + r")\s*[:\-]"
    for pattern in (rf"\s+(?={stops})| \| ", words(V.NOTE_RECIPE_WORDS), r"\broast\b", "[.;]"):
        c = cut(c, pattern)
    hints = "|".join(V.NOTE_HINTS)
    few = rf"(?=.*,)(?=\s*\S+(?:\s+\S+){{0,{V.FLAVOUR_LIST_WORDS - 1}}}\s*\z)"
    needs = rf"(?=.{{6}})(?!.*(?:{'|'.join(V.NOTE_REJECTS)}))(?:(?=.*(?:{hints}))|{few})"
    return accept(F.btrim(c, F.lit(" ,:-")), (None, 20), needs)


def flavour_from_text(text: Column) -> Column:
    """The first labelled list that reads like notes, else a list after 'cup'."""
    tries = [
        filled(_note_candidate(
            F.regexp_extract(text, rf"(?iU){label}({V.NOTE_CHARS}{{6,}})", 1)))
        for label in V.NOTE_LABELS
    ]
    loose = _note_candidate(F.regexp_extract(text, rf"(?iU)\bcup\b\s+({V.NOTE_CHARS}{{8,}})", 1))
    loose = F.regexp_extract(loose, r"(?is)^.*(?:,| and ).*\z", 0)
    return F.coalesce(*tries, loose)


def with_fields(df: DataFrame, *, text: str, body: str, tags: str | None = None,
                title: str | None = None, url: str | None = None,
                skip: str | None = None, aliases: str | None = None) -> DataFrame:
    """Add origin, process, varietal and flavour_profile to product rows.

    Structured values win over free text; every value passes its guard.  A
    field's two candidates go through one copy of its guard, and the free-text
    rules only look at rows whose structured value was refused or missing.
    """
    col = lambda name: F.col(name) if name else None
    df = df.withColumn("_raw", raw_fields(col(tags), F.col(body), col(skip), col(aliases)))
    free = F.col(text)
    rules = {
        "origin": lambda: origin_from_text(free),
        "process": lambda: process_from_text(free, col(title), col(url)),
        "varietal": lambda: varietal_from_text(free),
        "flavour": lambda: flavour_from_text(free),
    }
    names = {"flavour": "flavour_profile"}
    found = {f: F.col("_raw")[f] for f in V.FIELDS}
    df = df.withColumns({f"_{f}": GUARDS[f](c) for f, c in found.items()})
    for f in V.FIELDS:
        given = F.col(f"_{f}")
        loose = F.when(given == "", rules[f]())
        df = df.withColumn(f"_free_{f}", loose)
    for f in V.FIELDS:
        given, loose = F.col(f"_{f}"), F.col(f"_free_{f}")
        if f in ("origin", "flavour"):
            # these two guards see their own result once more, as trimming can go on
            value = let(F.coalesce(filled(given), loose), GUARDS[f])
        else:
            value = F.when(given != "", given).otherwise(let(loose, GUARDS[f]))
        df = df.withColumn(names.get(f, f), value)
    # what a guard refused stays to be seen, by field: the structured value, and under
    # '<field>_text' what the free text had instead
    def entry(f, suffix, value, gone):
        return F.struct(F.lit(names.get(f, f) + suffix).alias("key"), F.when(gone & (value != ""), value).alias("value"))

    lost = {f: F.col(names.get(f, f)) == "" for f in V.FIELDS}
    entries = [entry(f, "", F.col("_raw")[f], F.col(f"_{f}") == "") for f in V.FIELDS]
    entries += [entry(f, "_text", F.btrim(F.col(f"_free_{f}")), lost[f]) for f in V.FIELDS]
    refused = F.map_from_entries(F.filter(F.array(*entries), lambda e: e.value.isNotNull()))
    df = df.withColumn("refused", refused)
    return df.drop("_raw", *[f"_{f}" for f in V.FIELDS], *[f"_free_{f}" for f in V.FIELDS])
