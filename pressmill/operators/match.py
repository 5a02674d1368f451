"""Keyword matching and the predicates on candidate articles."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from pressmill.functions.text import fold, normalise, word_count

#: Parts of the addresses, and of the normalised titles, of rolling live pages.
LIVE_URL_PARTS = (
    "live-updates", "live-news", "liveblog", "live-blog", "news-live", "latest-marathi-news-live", "top-marathi-news",
    "breaking-news-live", "live-today", "news-today-live", "-live-",
)
LIVE_TITLE_PARTS = ("live updates", "news live", "live blog")
LEDE_WORDS = 120


def _present(normal: Column, keyword: str) -> Column:
    folded = fold(keyword)
    if re.search("[a-z0-9]", folded):
        return normal.rlike(r"(?<![a-z0-9])\Q" + folded.replace(r"\E", r"\E\\E\Q") + r"\E(?![a-z0-9])")
    return normal.contains(folded)


def matched_keywords(text: Column, keywords: Sequence[str]) -> Column:
    """The keywords in a text, as they were given and in that order.

    A keyword with a Latin letter or digit must not touch another one; any other is found
    anywhere. Blank keywords are skipped, but one of spaces finds spaces.
    """
    normal = normalise(text)
    hits = [F.when(_present(normal, k), F.lit(k)) for k in keywords if fold(k)]
    return F.array_compact(F.array(*hits)) if hits else F.array().cast("array<string>")


def match_location(title: Column, text: Column, keywords: Sequence[str]) -> Column:
    """``title/slug`` if the title alone has a keyword, ``body`` if only the text has, else null."""
    in_title, in_text = (F.size(matched_keywords(x, keywords)) > 0 for x in (title, text))
    return F.when(in_title, "title/slug").when(in_text, "body")


def contains_any(text: Column, parts: Sequence[str]) -> Column:
    found = F.lit(False)
    for p in parts:
        found = found | text.contains(p)
    return found


def is_live_page(url: Column, title: Column) -> Column:
    return contains_any(F.lower(url), LIVE_URL_PARTS) | contains_any(normalise(title), LIVE_TITLE_PARTS)


def in_sections(url: Column, sections: Column) -> Column:
    """No sections, or one of them somewhere in the lower-case address."""
    return (F.coalesce(F.size(sections), F.lit(0)) <= 0) | F.exists(sections, lambda s: F.lower(url).contains(s))


def nested_included(url: Column, include: Column) -> Column:
    """As ``in_sections``, with capitals told apart."""
    return (F.coalesce(F.size(include), F.lit(0)) <= 0) | F.exists(include, lambda s: url.contains(s))


def in_window(published: Column, first_day: Column, last_day: Column) -> Column:
    """Dated, and from the first day's midnight to the last day's last whole second."""
    last = last_day.cast("timestamp_ntz") + F.expr("interval '23:59:59' hour to second")
    return published.isNotNull() & published.between(first_day.cast("timestamp_ntz"), last)


def worth_walking(lastmod: Column, first: Column, last: Column) -> Column:
    """A nested sitemap is walked unless it was last changed before, or over a day after, the window."""
    return lastmod.isNull() | lastmod.between(first, last + F.expr("interval 1 day"))


def long_enough(text: Column, least: int) -> Column:
    return word_count(text) >= least


def lede_only(text: Column) -> Column:
    return word_count(text) < LEDE_WORDS
