"""Text clean-up: entities, tags, white space, keys.

Everything is a built-in expression except decoding of rare entities and
compatibility normalisation, for which Spark has no function.  Those two go
through Arrow, and only the rows that need them: every other row sends NULL.
"""

from __future__ import annotations

import html
import re
import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from shelf import vocabulary as V

# entities decoded by plain replacement; '&amp;' has to stay last, so that its
# ampersand cannot start another entity
_COMMON_ENTITIES = {
    "lt": "<", "gt": ">", "quot": '"', "apos": "'", "#39": "'", "nbsp": "\u00a0",
    "#36": "$", "#x24": "$", "copy": "©", "middot": "·", "ndash": "–", "mdash": "—",
    "rsquo": "’", "lsquo": "‘", "hellip": "…", "amp": "&",
}
_RARE_ENTITY = "&(?!(?:" + "|".join(_COMMON_ENTITIES) + ");)[#A-Za-z]"
# white space other than one plain blank, which most of it is and can stay
_SPACE = r"(?U)(?: [\s\x1c-\x1f]|[\s\x1c-\x1f&&[^ ]])[\s\x1c-\x1f]*"
_NOT_PLAIN = "(?: [^a-z0-9]|[^a-z0-9 ])[^a-z0-9]*"


def _text_udf(change):
    """An Arrow function over texts.  The inner function is shipped by value,
    so executors do not need this package installed."""
    def over(texts: pd.Series) -> pd.Series:
        return texts.map(change, na_action="ignore")

    return F.pandas_udf(over, StringType())


def _unescape_lists():
    """Entities that are closed by a semicolon decoded in all texts of a list."""
    closed = r"&(?:#[0-9]+|#[xX][0-9A-Fa-f]+|[A-Za-z][A-Za-z0-9]*);"

    def over(lists: pd.Series) -> pd.Series:
        one = lambda t: re.sub(closed, lambda m: html.unescape(m[0]), t)
        return lists.map(lambda texts: [None if t is None else one(t) for t in texts], na_action="ignore")

    return F.pandas_udf(over, ArrayType(StringType()))


unescape_all = _unescape_lists()
_unescape = _text_udf(lambda t: html.unescape(t))
_unescape_nfkc = _text_udf(lambda t: unicodedata.normalize("NFKC", html.unescape(t)))


def blank(c: Column) -> Column:
    """NULL as the empty string."""
    return F.coalesce(c, F.lit(""))


def filled(c: Column) -> Column:
    """The empty string as NULL, so that coalesce moves on.  The value is bound, for behind
    a condition ``nullif`` would work it out twice, and nested ones four times."""
    return let(c, lambda x: F.when(x != "", x))


def let(value: Column, body) -> Column:
    """Bind ``value`` once and use it many times inside ``body``."""
    return F.element_at(F.transform(F.array(value), body), 1)


def unnest(df: DataFrame, array: Column | str, pos: str, value: str, *keep) -> DataFrame:
    """One row per element.  The outer form with a filter behind it, because the
    plain form makes Spark compute the array a second time to see if it is empty -
    a second parse of every payload."""
    rows = df.select(*keep, F.posexplode_outer(array).alias(pos, value))
    return rows.where(F.col(pos).isNotNull())


def cut(c: Column, pattern: str, flags: str = "iUs") -> Column:
    """Drop everything from the first match on."""
    return F.regexp_replace(c, f"(?{flags})(?:{pattern}).*\\z", "")


def words(fragments) -> str:
    """A word-bounded alternation."""
    return r"\b(?:" + "|".join(fragments) + r")\b"


def _decode_common(c: Column) -> Column:
    for name, char in _COMMON_ENTITIES.items():
        c = F.replace(c, F.lit(f"&{name};"), F.lit(char))
    return c


def decode_entities(c: Column) -> Column:
    rare = _unescape(F.when(c.rlike(_RARE_ENTITY), c))
    common = F.when(F.contains(c, F.lit("&")), _decode_common(c)).otherwise(c)
    return F.coalesce(rare, common)


def squeeze(c: Column) -> Column:
    """Collapse white space and trim."""
    return F.btrim(F.regexp_replace(c, _SPACE, " "))


def strip_tags(c: Column) -> Column:
    return F.regexp_replace(c, "<[^>]+>", " ")


def strip_html(c: Column) -> Column:
    """Tags out, white space collapsed; entities stay."""
    return squeeze(strip_tags(blank(c)))


def clean_text(c: Column) -> Column:
    """Entities decoded first, then tags out, so an escaped tag vanishes too."""
    return squeeze(strip_tags(decode_entities(blank(c))))


def match_text(c: Column, cleaned: bool = False) -> Column:
    """Lower-case ASCII letters and digits, all else one space.

    ``cleaned`` says that the text has been through ``clean_text`` or is an
    address, so that it need not be decoded again.
    """
    plain = blank(c) if cleaned else strip_tags(decode_entities(blank(c)))
    return F.btrim(F.regexp_replace(F.lower(plain), _NOT_PLAIN, " "))


def key_text(c: Column) -> Column:
    """Key form: decoded, NFKC, dashes unified, collapsed, lower case."""
    c = blank(c)
    normal = F.coalesce(_unescape_nfkc(F.when(c.rlike(r"[^\x00-\x7f]|&[#A-Za-z]"), c)), c)
    return F.lower(squeeze(F.translate(normal, V.DASHES, "-" * len(V.DASHES))))


def strip_markup(html_text: Column) -> Column:
    """Comments, scripts, styles and tags out of a page; entities stay."""
    body = F.regexp_replace(blank(html_text), "(?s)<!--.*?-->", " ")
    body = F.regexp_replace(
        body, r"(?is)<(script|style|template)\b[^>]*>.*?</\1\s*>", " "
    )
    return squeeze(F.regexp_replace(body, "<[!?/A-Za-z][^>]*>", " "))


def plain_text(html_text: Column) -> Column:
    """Text of a short piece of a page, common entities decoded."""
    return squeeze(_decode_common(strip_tags(blank(html_text))))


def with_page_text(df: DataFrame, **pages: Column) -> DataFrame:
    """Add the text of pages: markup out, entities decoded, then cleaned once more
    as every free text is.  Each step is a column of its own, used by the next, so
    plans stay small and no step is computed twice."""
    names = list(pages)
    df = df.withColumns({f"_{n}": strip_markup(c) for n, c in pages.items()})
    df = df.withColumns({f"_{n}": decode_entities(F.col(f"_{n}")) for n in names})
    df = df.withColumns({n: clean_text(F.col(f"_{n}")) for n in names})
    return df.drop(*[f"_{n}" for n in names])


def unescape_slashes(c: Column) -> Column:
    """Addresses inside JSON blobs: ``\\/`` and the escapes of '/' and ':'."""
    for raw, char in (
        ("\\/", "/"), ("\\u002F", "/"), ("\\u002f", "/"), ("\\u003A", ":"), ("\\u003a", ":"),
    ):
        c = F.replace(c, F.lit(raw), F.lit(char))
    return c
