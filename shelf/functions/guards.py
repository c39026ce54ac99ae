"""Guards: each takes a raw value and returns it tidied, or '' if it is no such value.

A guard is a straight chain of regular-expression rewrites that mentions its
input once.  The last step is an extraction whose look-aheads state the whole
acceptance rule: no match gives ''.  So plans stay linear in size and inside
generated code.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from shelf import vocabulary as V
from shelf.functions.text import blank, cut, let, words

EDGES = " ,;:-"


def accept(c: Column, limits: tuple[int | None, int], needs: str = "") -> Column:
    """Keep the value if it is short enough (characters, words) and meets the look-aheads."""
    chars, count = limits
    chars = "" if chars is None else chars
    return F.regexp_extract(
        c, rf"(?iUs)^(?=.{{1,{chars}}}\z){needs}{_word_run(count)}\z", 0
    )


def _word_run(count: int) -> str:
    return rf"\s*\S+(?:\s+\S+){{0,{count - 1}}}\s*"


def _any_of(texts) -> str:
    return "|".join(re.escape(t) for t in texts)


def process_guard(c: Column) -> Column:
    """Known process phrases in list order; one inside a longer one is dropped.

    One alternation, longer phrases first, finds them all in one pass.
    """
    pattern = r"(?U)\b(" + "|".join(re.escape(p.lower()) for p in V.PROCESS_PHRASES) + r")\b"
    found = F.regexp_extract_all(F.lower(blank(c)), F.lit(pattern), F.lit(1))

    def listed(seen):
        terms = []
        for i, phrase in enumerate(V.PROCESS_PHRASES):
            test = F.array_contains(seen, phrase.lower())
            for wider in V.PROCESS_PHRASES[:i]:
                if phrase.lower() in wider.lower():
                    test = test & ~F.array_contains(seen, wider.lower())
            terms.append(F.when(test, F.lit(phrase)))
        return F.concat_ws(", ", *terms)

    return let(F.array_distinct(found), listed)


def varietal_guard(c: Column) -> Column:
    """A short list of varieties: no label, cup notes, prose or trailing place."""
    c = F.btrim(blank(c), F.lit(EDGES))
    for pattern in (":", r"\bcup\b", words(V.VARIETAL_PROSE)):
        c = F.btrim(cut(c, pattern), F.lit(" ,"))
    junk = _any_of(V.PLACES + V.VARIETAL_JUNK)
    c = F.regexp_replace(c, rf"(?iU)(?:(?:^|,)\s*(?:{junk})?\s*)+\z", "")
    c = F.regexp_replace(c, r"(?U)\s*,[\s,]*", ", ")
    return accept(F.btrim(c, F.lit(" ,")), V.VARIETAL_LIMITS)


def origin_guard(c: Column) -> Column:
    """'Place, Region, Country': needs a comma or a known place."""
    c = F.btrim(blank(c), F.lit(EDGES))
    c = F.btrim(cut(c, r"\s+:\s+|[.;|]"), F.lit(" ,"))
    verb = words(V.ORIGIN_CUTS)
    # a verb at the very start is left for the other rules to decide
    c = F.btrim(F.regexp_replace(c, rf"(?iUs)^(?!{verb})(.+?){verb}.*\z", "$1"), F.lit(" ,"))
    c = cut(c, r"^(?:" + "|".join(V.ORIGIN_LEADS) + r")\b")
    return accept(c, V.ORIGIN_LIMITS, rf"(?=.*(?:,|{_any_of(V.PLACES)}))")


def flavour_guard(c: Column) -> Column:
    """A short list of notes: needs a hint word, or a comma and few words."""
    c = F.btrim(blank(c), F.lit(EDGES))
    c = F.btrim(cut(c, r"[.;]|\s*\|\s*|\b\d+\s*%|" + words(V.FLAVOUR_CUTS)), F.lit(EDGES))
    c = F.regexp_replace(c, rf"(?iU)\s+{words(V.FLAVOUR_TRAILS)}\z", "")
    few = rf"(?=.*,)(?={_word_run(V.FLAVOUR_LIST_WORDS)}\z)"
    hint = rf"(?=.*(?:{_any_of(V.FLAVOUR_HINTS)}))"
    return accept(F.btrim(c, F.lit(EDGES)), V.FLAVOUR_LIMITS, f"(?:{hint}|{few})")


GUARDS = {
    "origin": origin_guard,
    "process": process_guard,
    "varietal": varietal_guard,
    "flavour": flavour_guard,
}
