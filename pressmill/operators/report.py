"""Corpus text, tallies, exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pressmill.functions.text import sigmoid, template_safe, word_count

MAX_CHARS = 6000
#: The layout of a corpus entry.
TRUNCATED = " …[truncated]"
LEDE_NOTE = "Note: lede only -- full text is behind the publisher's paywall.\n"
CSV_COLUMNS = ("source", "published", "title", "url", "relevance", "words", "lang")


def corpus_entry(max_chars: int = MAX_CHARS) -> Column:
    """The text block of a numbered document; its relevance line has the raw score."""
    text = F.col("text")
    body = F.concat(F.substring(text, 1, max_chars), F.when(F.length(text) > max_chars, TRUNCATED).otherwise(""))
    note = F.when(F.col("partial"), LEDE_NOTE).otherwise("")
    return F.concat(
        F.lit("=== ARTICLE "), F.col("n"), F.lit(" ===\nSource: "), F.col("source"), F.lit("\nPublished: "), F.col("published"),
        F.lit("\nLanguage: "), F.col("lang"), F.lit("\nURL: "), F.col("url"), F.lit("\nRelevance: "), F.format_string("%.3f", F.col("score")),
        F.lit("\n"), note, F.lit("Headline: "), F.col("title"), F.lit("\n\n"), body, F.lit("\n"),
    )


def corpus_text(numbered: DataFrame, max_chars: int = MAX_CHARS) -> DataFrame:
    """One row ``corpus``: the entries in order. For a report's few documents, which one prompt holds."""
    entries = numbered.select("n", corpus_entry(max_chars).alias("entry"))
    gathered = entries.agg(F.array_sort(F.collect_list(F.struct("n", "entry"))).alias("all"))
    return gathered.select(F.array_join(F.transform("all", lambda e: e["entry"]), "\n").alias("corpus"))


def corpus_lines(numbered: DataFrame, max_chars: int = MAX_CHARS) -> DataFrame:
    """``(n, value)`` ready to be written as text in order, for corpora of any size."""
    return numbered.select("n", corpus_entry(max_chars).alias("value")).orderBy("n")


def facts(numbered: DataFrame) -> DataFrame:
    """``(articles, outlets)`` of a numbered corpus, from its rows: a body that looks like a header is not counted."""
    outlets = tally_line(numbered, "source", "n").select(F.col("listed").alias("outlets"))
    return numbered.agg(F.count("*").alias("articles")).crossJoin(F.broadcast(outlets))


def facts_of_text(corpora: DataFrame, column: str = "corpus") -> DataFrame:
    """``(articles, outlets)`` as the rendered text tells them, lines of bodies that look alike included."""
    text = F.col(column)
    names = F.posexplode(F.regexp_extract_all(text, F.lit(r"(?m)^Source:\s*(.+?)\s*$"), F.lit(1))).alias("pos", "name")
    counted = corpora.select(names).groupBy("name").agg(F.count("*").alias("n"), F.min("pos").alias("pos"))
    listed = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("k"), "pos", F.format_string("%s (%d)", "name", "n").alias("item"))))
    outlets = counted.agg(F.array_join(F.transform(listed, lambda x: x["item"]), ", ").alias("outlets"))
    return corpora.select(F.regexp_count(text, F.lit(r"(?m)^=== ARTICLE \d+ ===")).cast("long").alias("articles")).crossJoin(F.broadcast(outlets))


def tally(docs: DataFrame, key: str, position: str) -> DataFrame:
    """``(key, n, first_at)``, most frequent first, ties by first occurrence."""
    return docs.groupBy(key).agg(F.count("*").alias("n"), F.min(position).alias("first_at")).orderBy(F.desc("n"), "first_at")


def tally_line(docs: DataFrame, key: str, position: str) -> DataFrame:
    """One row ``listed``: ``name (n)`` of each value in the tally's order, for keys as few as outlets."""
    item = F.struct((-F.col("n")).alias("k"), "first_at", F.format_string("%s (%d)", key, "n").alias("item"))
    ordered = F.array_sort(F.collect_list(item))
    return tally(docs, key, position).agg(F.array_join(F.transform(ordered, lambda x: x["item"]), ", ").alias("listed"))


def run_articles(docs: DataFrame) -> DataFrame:
    """What a run lists of its documents: all but the text, with relevance and words."""
    return docs.withColumn("relevance", sigmoid(F.col("score"))).withColumn("words", word_count(F.col("text"))).drop("text")


def csv_rows(articles: DataFrame, with_text: bool = False) -> DataFrame:
    """The export's columns in order, relevance with four decimals."""
    names = [*CSV_COLUMNS, *(["text"] if with_text else [])]
    return articles.withColumn("relevance", F.format_string("%.4f", "relevance")).select(*names)


def write_csv(articles: DataFrame, path: str, with_text: bool = False) -> None:
    """One file for spreadsheets, quoted throughout; its first bytes are the byte order mark that they look for.

    Lines are made in parallel; one task writes them in a stream.
    """
    rows = csv_rows(articles, with_text)
    quoted = [F.concat(F.lit('"'), F.replace(F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit('"'), F.lit('""')), F.lit('"')) for c in rows.columns]
    head = "\ufeff" + ",".join(f'"{c}"' for c in rows.columns)
    lines = rows.sparkSession.range(0, 1, 1, 1).select(F.lit(head).alias("value")).union(rows.select(F.concat_ws(",", *quoted).alias("value")))
    lines.coalesce(1).write.mode("overwrite").text(path)


def prompts(profiles: DataFrame, human: str) -> DataFrame:
    """``(id, system, human)``: the messages of a report for each profile; braces of a brief are text, not slots.

    A profile without a brief has none, and is left out.
    """
    brief = F.coalesce("system_prompt", F.lit(""))
    return profiles.where(F.trim(brief) != "").select("id", template_safe(brief).alias("system"), F.lit(human).alias("human"))


def prompt(brief: str | None, human: str) -> list[tuple[str, str]]:
    """One brief's messages; a blank brief is an error."""
    from pyspark.sql import SparkSession

    row = prompts(SparkSession.active().createDataFrame([("", brief)], "id string, system_prompt string"), human).first()
    if row is None:
        raise ValueError("no brief for this profile")
    return [("system", row["system"]), ("human", row["human"])]
