"""From documents to a ranked, numbered corpus: duplicates out, scored, floored, written."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pressmill.functions.text import word_count
from pressmill.operators.dedupe import THRESHOLD, dedupe
from pressmill.operators.rank import FLOOR, Scorer, numbered, relevant, scored
from pressmill.operators.report import corpus_lines, run_articles
from pressmill.storage import written


@dataclass
class Corpus:
    """All scored documents, those that count, and how many rows each stage left."""

    ranked: DataFrame
    kept: DataFrame
    counts: dict[str, int]


def build_corpus(docs: DataFrame, query: str, scorer: Scorer | None = None, floor: float = FLOOR, threshold: float = THRESHOLD) -> Corpus:
    """``docs(url, source, published, title, text, lang, partial)``; ties are broken by address."""
    docs = written(docs, "extracted")
    order = [(-word_count(F.col("text"))).alias("w"), F.col("url")]
    verdict = dedupe(docs, order, "url", threshold=threshold)
    unique = docs.join(verdict.where("dupe_of is null").select(F.col("id").alias("url")), "url", "left_semi")
    ranked = written(scored(unique, query, scorer), "scored")
    by_score = [F.desc("score"), F.desc("published"), F.asc("url")]
    kept = written(numbered(relevant(ranked, floor), by_score), "numbered")
    counts = {"extracted": docs.count(), "ranked": ranked.count(), "kept": kept.count()}
    counts["duplicates"] = counts["extracted"] - counts["ranked"]
    return Corpus(ranked, kept, counts)


def write_run(corpus: Corpus, folder: str) -> None:
    """The run's article list (all scored), corpus records and corpus text (those that count)."""
    run_articles(corpus.ranked).write.mode("overwrite").json(f"{folder}/articles")
    corpus.kept.write.mode("overwrite").json(f"{folder}/corpus")
    corpus_lines(corpus.kept).select("value").write.mode("overwrite").option("lineSep", "\n").text(f"{folder}/corpus-text")
