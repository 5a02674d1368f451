"""Small keyed records: profiles and runs, as JSON tables that are replaced as a whole."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pressmill.functions.text import slug
from pressmill.schema import PROFILE, RUN_META
from pressmill.sources.archive import exists
from pressmill.storage import written

DEFAULT_BRIEF = "Summarise the coverage of the subject from the numbered articles, and cite them by number."


def read_json(spark: SparkSession, path: str, schema) -> DataFrame:
    return spark.read.schema(schema).json(path) if exists(spark, path) else spark.createDataFrame([], schema)


def load_profiles(spark: SparkSession, path: str, brief: str = DEFAULT_BRIEF) -> DataFrame:
    """Profiles by creation and name, blank briefs filled in."""
    return with_briefs(read_json(spark, path, PROFILE), brief).orderBy("created", "name", "id")


def with_briefs(profiles: DataFrame, brief: str = DEFAULT_BRIEF) -> DataFrame:
    filled = F.when(F.trim(F.coalesce("system_prompt", F.lit(""))) == "", F.lit(brief)).otherwise(F.col("system_prompt"))
    return profiles.withColumn("system_prompt", filled)


def checked(profiles: DataFrame) -> DataFrame:
    """Trimmed, blank terms dropped, ids made of names; ``problem`` says what is wrong, if anything."""
    terms = F.filter(F.transform(F.coalesce("terms", F.array().cast("array<string>")), lambda t: F.trim(t)), lambda t: t != "")
    out = profiles.withColumn("name", F.trim(F.coalesce("name", F.lit("")))).withColumn("terms", terms)
    own = F.when(F.trim(F.coalesce("id", F.lit(""))) != "", F.trim("id")).otherwise(slug(F.col("name")))
    out = out.withColumn("id", own)
    problem = F.when(F.col("name") == "", "no name").when(F.size("terms") == 0, "no terms").when(F.col("id") == "", "no id")
    return out.withColumn("problem", problem)


def upserted(stored: DataFrame, changes: DataFrame, replace_all: bool = False) -> DataFrame:
    """Stored rows with the changes' rows put in by id; with ``replace_all`` nothing else stays.

    A row that was there keeps its time of creation.
    """
    created = stored.select("id", F.col("created").alias("_was"))
    new = changes.join(created, "id", "left").withColumn("created", F.coalesce("_was", "created")).select(*stored.columns)
    return new if replace_all else stored.join(changes.select("id"), "id", "left_anti").select(*stored.columns).unionByName(new)


def deleted(stored: DataFrame, id_: str) -> tuple[DataFrame, bool]:
    """The rows left, and whether there was one to delete."""
    return stored.where(F.col("id") != id_), not stored.where(F.col("id") == id_).isEmpty()


def save(records: DataFrame, path: str) -> None:
    """Replaces a table that ``records`` may be read from: written aside first."""
    written(records, "registry").coalesce(1).write.mode("overwrite").json(path)


def merge_meta(stored: DataFrame, changes: DataFrame) -> DataFrame:
    """Run records with the fields that ``changes`` names (not null) laid over them."""
    columns = [c for c in RUN_META.names if c != "id"]
    old, new = stored.select("id", F.struct(*columns).alias("o")), changes.select("id", F.struct(*columns).alias("c"))
    both = old.join(new, "id", "full_outer")
    return both.select("id", *[F.coalesce(F.col(f"c.{c}"), F.col(f"o.{c}")).alias(c) for c in columns])


def list_runs(meta: DataFrame, reports: DataFrame) -> DataFrame:
    """Runs, newest (greatest id) first, with whether they have a report."""
    has = reports.select("id").distinct().withColumn("has_report", F.lit(True))
    return meta.join(has, "id", "left").withColumn("has_report", F.coalesce("has_report", F.lit(False))).orderBy(F.desc("id"))


def run_articles(spark: SparkSession, path: str) -> DataFrame:
    from pressmill.schema import RUN_ARTICLE

    return read_json(spark, path, RUN_ARTICLE)


def read_text(spark: SparkSession, path: str) -> str | None:
    """The whole text of a report, or of a corpus that one prompt holds, or None; part files in order of their names."""
    if not exists(spark, path):
        return None
    rows = spark.read.text(path, wholetext=True).select("value", "_metadata.file_path").orderBy("file_path").collect()
    return "".join(r["value"] for r in rows)
