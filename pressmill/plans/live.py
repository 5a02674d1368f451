"""The live run: candidates, shallow and deep matching, extraction, clean documents."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pressmill.functions.html import extract_archive, extract_live
from pressmill.functions.text import minute, slug_words, word_count
from pressmill.operators.clean import strip_boilerplate
from pressmill.operators.keys import first_per_key
from pressmill.operators.match import is_live_page, lede_only, match_location, matched_keywords

DEEP_LIMIT = 400
MIN_WORDS = 60
SHELL_WORDS = 25
#: Columns of the match table.
TABLE = ("Source", "Language", "Published", "Title", "Keyword", "Matched In", "Links")


def candidates_matched(candidates: DataFrame, pages: DataFrame, keywords: Sequence[str], deep: bool = True, deep_limit: int = DEEP_LIMIT) -> DataFrame:
    """The match table over ``candidates(source, source_index, position, url, published, title, keywords, language)``.

    Shallow hits are in title, keywords or address words. Of the others the first ``deep_limit``
    in source order have their page (``pages(url, html)``) read and matched. Live pages go, and
    an address counts once, shallow before deep.
    """
    shallow_text = F.concat_ws(" ", "title", "keywords", slug_words(F.col("url")))
    marked = candidates.withColumn("matched", matched_keywords(shallow_text, keywords))
    html = pages.select("url", "html")
    shallow = marked.where(F.size("matched") > 0).withColumn("where", F.lit("title/slug"))
    untitled = shallow.where("title = ''").join(html, "url", "left").withColumn("title", F.coalesce(extract_archive("html")["title"], F.lit(""))).drop("html")
    hits = shallow.where("title <> ''").unionByName(untitled).withColumn("pass", F.lit(0))
    if deep:
        few = marked.where(F.size("matched") == 0).orderBy("source_index", "position", "url").limit(deep_limit)
        read = few.join(html, "url").withColumn("x", extract_archive("html")).drop("html")
        read = read.withColumn("title", F.when(F.col("title") == "", F.col("x.title")).otherwise(F.col("title")))
        text = F.concat_ws(" ", "title", "x.body")
        read = read.withColumn("matched", matched_keywords(text, keywords)).withColumn("where", match_location(F.col("title"), text, keywords))
        hits = hits.unionByName(read.where(F.size("matched") > 0).drop("x").withColumn("pass", F.lit(1)))
    hits = hits.where(~is_live_page(F.col("url"), F.col("title")))
    hits = first_per_key(hits, "url", [F.asc("pass"), F.asc("source_index"), F.asc("position")])
    columns = [F.col("source"), F.col("language"), minute(F.col("published")), F.col("title"), F.array_join("matched", ", "), F.col("where"), F.col("url")]
    return hits.select(*[c.alias(n) for c, n in zip(columns, TABLE, strict=True)])


def ordered(matches: DataFrame) -> DataFrame:
    return matches.orderBy(F.desc("Published"), "Source", "Links")


def documents(matches: DataFrame, pages: DataFrame, min_words: int = MIN_WORDS, separator: str = "\n\n") -> DataFrame:
    """Extracted, boilerplate-free documents of a match table; ``partial`` marks ledes."""
    read = matches.join(pages.select(F.col("url").alias("Links"), "html"), "Links").withColumn("x", extract_live("html"))
    docs = read.select(
        F.col("Links").alias("url"), F.col("Source").alias("source"), F.col("Published").alias("published"),
        F.when(F.col("x.title") != "", F.col("x.title")).otherwise(F.coalesce("Title", F.lit(""))).alias("title"),
        F.col("x.body").alias("text"), F.col("Language").alias("lang"),
    )
    docs = strip_boilerplate(docs.where(word_count(F.col("text")) >= SHELL_WORDS), separator=separator)
    return docs.where(word_count(F.col("text")) >= min_words).withColumn("partial", lede_only(F.col("text")))
