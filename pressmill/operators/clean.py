"""Boilerplate lines, found by how many of a source's documents have them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

MIN_SHARE = 0.3
MIN_DOCS = 3
PARAGRAPH = "\n\n"


def line_frequency(docs: DataFrame, separator: str = PARAGRAPH, least: int = MIN_DOCS) -> DataFrame:
    """``(source, line_hash, n, of, share)`` of lines that ``least`` or more of a source's documents have.

    Lines travel as 64-bit hashes with one count for each document, and are counted before the
    shuffle; the text of the corpus does not move.
    """
    lines = docs.select("source", F.explode(F.array_distinct(F.transform(F.split("text", separator, -1), lambda x: F.xxhash64(x)))).alias("line_hash"))
    counts = lines.groupBy("source", "line_hash").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    sizes = docs.groupBy("source").agg(F.count("*").alias("of"))
    return counts.join(sizes, "source").withColumn("share", F.col("n") / F.col("of"))


def strip_boilerplate(docs: DataFrame, min_share: float = MIN_SHARE, separator: str = PARAGRAPH) -> DataFrame:
    """Cuts lines that a share of a source's documents (and three of them) have; adds ``removed``.

    A source's cut lines are at most its mean number of lines over ``min_share``, so the array
    that is joined to its documents is small whatever the number of documents. Empty text is
    one empty line; a null text stays null.
    """
    cut = line_frequency(docs, separator).where(F.col("share") >= min_share)
    cut = cut.groupBy("source").agg(F.collect_list("line_hash").alias("_cut"))
    out = docs.join(cut, "source", "left")
    lines = F.split("text", separator, -1)
    kept = F.filter(lines, lambda x: ~F.array_contains("_cut", F.xxhash64(x)))
    kept = F.when(F.col("_cut").isNull(), lines).otherwise(kept)
    out = out.withColumn("_kept", kept).withColumn("removed", (F.size(lines) - F.size("_kept")).cast("long"))
    return out.withColumn("text", F.array_join("_kept", separator)).select(*docs.columns, "removed")


def line_shares(docs: DataFrame, separator: str) -> DataFrame:
    """``(source, line, n, share)``: lines themselves, for a report on boilerplate."""
    lines = docs.select("source", "doc_id", F.explode(F.array_distinct(F.split("text", separator, -1))).alias("line"))
    common = line_frequency(docs, separator).select("source", "line_hash", "n", "share")
    found = lines.withColumn("line_hash", F.xxhash64("line")).join(common, ["source", "line_hash"])
    one = F.row_number().over(Window.partitionBy("source", "line_hash").orderBy("doc_id"))
    return found.withColumn("_nth", one).where("_nth = 1").select("source", "line", "n", "share")
