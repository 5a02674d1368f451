"""Command line: search an archive, build a corpus, take in a harvest, import profiles.

    python -m pressmill search --archive A --first 2024-01-01 --last 2024-01-07 --terms "x, y" --out DIR
    python -m pressmill corpus --archive A ... --subject "x" --out DIR
    python -m pressmill harvest --archive A --found PARQUET [--sources "One, Two"]
    python -m pressmill import-profiles --profiles P --file F [--dry-run]
"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pressmill.operators.rank import FLOOR
from pressmill.plans.corpus import build_corpus, write_run
from pressmill.plans.search import MIN_WORDS, search
from pressmill.schema import PROFILE
from pressmill.session import session
from pressmill.sources import archive, registry
from pressmill.storage import written


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="pressmill")
    sub = p.add_subparsers(dest="command", required=True)
    for name in ("search", "corpus"):
        c = sub.add_parser(name)
        for flag in ("archive", "first", "last", "out"):
            c.add_argument(f"--{flag}", required=True)
        c.add_argument("--terms", default="", help="comma-separated keywords; none match all")
        c.add_argument("--min-words", type=int, default=MIN_WORDS)
        if name == "corpus":
            c.add_argument("--subject", required=True)
            c.add_argument("--min-relevance", type=float, default=FLOOR)
    c = sub.add_parser("harvest")
    c.add_argument("--archive", required=True)
    c.add_argument("--found", required=True)
    c.add_argument("--sources", default="")
    c = sub.add_parser("import-profiles")
    c.add_argument("--profiles", required=True)
    c.add_argument("--file", required=True)
    c.add_argument("--dry-run", action="store_true")
    return p


def found(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    terms = [t.strip() for t in a.terms.split(",") if t.strip()]
    rows = archive.read_range(spark, a.archive, a.first, a.last)
    return search(rows, terms, [F.asc("day"), F.asc("source_slug"), F.asc("published"), F.asc("text")], a.min_words)


def run_harvest(spark: SparkSession, a: argparse.Namespace) -> int:
    """1 if the harvest is implausibly small, 2 if no source has one of the names."""
    new = spark.read.parquet(a.found)
    names = [n.strip().lower() for n in a.sources.split(",") if n.strip()]
    if names:
        new = new.where(F.lower("source").isin(names))
        if new.isEmpty():
            return 2
    stored = archive.read_archive(spark, a.archive).select(*new.columns)
    whole, counters = archive.harvest(new, stored)
    counters = written(counters, "counters")
    archive.write_days(written(whole, "harvest"), a.archive)
    counters.orderBy("source").show(1000, truncate=False)
    return 0 if archive.plausible(counters).first()["ok"] else 1


def import_profiles(spark: SparkSession, a: argparse.Namespace) -> int:
    given = registry.checked(spark.read.schema(PROFILE).option("multiLine", True).json(a.file))
    given.select("id", "name", "terms", "problem").show(1000, truncate=False)
    if not given.where("problem is not null").isEmpty():
        return 2
    if not a.dry_run:
        stored = registry.read_json(spark, a.profiles, PROFILE)
        registry.save(registry.upserted(stored, given.drop("problem")), a.profiles)
    return 0


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    a = _parser().parse_args(argv)
    spark = spark or session()
    if a.command == "harvest":
        return run_harvest(spark, a)
    if a.command == "import-profiles":
        return import_profiles(spark, a)
    docs = found(spark, a)
    if a.command == "search":
        docs.drop("text").write.mode("overwrite").json(a.out)
        return 0
    docs = docs.select("url", "source", F.coalesce("published", F.lit("")).alias("published"), "title", "text", F.col("language").alias("lang"), F.lit(False).alias("partial"))
    write_run(build_corpus(docs, a.subject, floor=a.min_relevance), a.out)
    return 0


if __name__ == "__main__":
    sys.exit(main())
