"""Block rules: phrase list, per-shop patterns, feed pages."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from shelf import vocabulary as V
from shelf.functions.text import blank, clean_text, match_text


def phrase_pattern(phrases, patterns=()) -> str:
    """All phrases and patterns as one alternation, built once on the driver.

    Phrases share their word boundaries and are grouped by first letter, so that
    at most a few of them are tried, and only where a word starts.
    """
    by_letter: dict[str, list[str]] = {}
    for phrase in phrases:
        by_letter.setdefault(phrase[0], []).append(
            r"\s+".join(re.escape(w) for w in phrase.split())[len(re.escape(phrase[0])):])
    groups = [re.escape(letter) + "(?:" + "|".join(rest) + ")" for letter, rest in by_letter.items()]
    return "|".join([r"\b(?:" + "|".join(groups) + r")\b", *patterns])


BLOCKED = phrase_pattern(V.BLOCKED_PHRASES, V.BLOCKED_PATTERNS)


def is_blocked(text: Column, pattern: str = BLOCKED, cleaned: bool = False) -> Column:
    return match_text(text, cleaned).rlike(pattern)


def is_blocked_for(shop: Column, text: Column, pattern: str = BLOCKED,
                   shop_patterns: dict[str, list[str]] | None = None, cleaned: bool = False) -> Column:
    """The general list, and what a single shop adds to it."""
    blocked = is_blocked(text, pattern, cleaned)
    own = V.SHOP_BLOCKED_PATTERNS if shop_patterns is None else shop_patterns
    for name, extra in own.items():
        hit = F.lower(text if cleaned else clean_text(text)).rlike("(?U)" + "|".join(extra))
        blocked = blocked | ((F.lower(F.trim(shop)) == name) & hit)
    return blocked


def path_words(path: Column) -> Column:
    """An address path as words, for the block list."""
    return F.translate(path, "/-", "  ")


def is_feed(content_type: Column) -> Column:
    return F.lower(blank(content_type)).rlike("xml|rss|atom")
