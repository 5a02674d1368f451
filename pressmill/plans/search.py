"""Archive search: stored records of a window that match keywords, as documents."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pressmill.functions.text import word_count
from pressmill.operators.keys import first_per_key
from pressmill.operators.match import is_live_page, matched_keywords

MIN_WORDS = 25


def search(
    records: DataFrame,
    keywords: Sequence[str],
    order: Sequence[Column],
    min_words: int = MIN_WORDS,
    drop_live_pages: bool = True,
) -> DataFrame:
    """Adds ``words`` and ``matched``; one row for each address, the first in ``order`` that passes.

    Cheap tests come first: Spark keeps filters in the order they are given. No keywords match all.
    Days are pruned by the caller's partition filter (``read_range``).
    """
    out = records.withColumn("words", word_count(F.col("text"))).where(F.col("words") >= min_words)
    out = out.withColumn("title", F.coalesce("title", F.lit(""))).withColumn("url", F.coalesce("url", F.lit("")))
    text = F.concat_ws("\n", "title", "text")
    out = out.withColumn("matched", matched_keywords(text, keywords) if keywords else F.array().cast("array<string>"))
    if keywords:
        out = out.where(F.size("matched") > 0)
    if drop_live_pages:
        out = out.where(~is_live_page(F.col("url"), F.col("title")))
    return first_per_key(out, "url", order)
