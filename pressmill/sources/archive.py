"""The article archive: gzipped JSON lines by day and source, written by replacement.

Layout ``<root>/day=YYYY-MM-DD/source_slug=<slug>/part-*.json.gz``: a day's or source's files are
found by partition pruning, and replacing one (day, source) is a dynamic partition overwrite
under Spark's commit protocol. Counts come from an aggregation over the two partition columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pressmill.functions.text import slug
from pressmill.operators.keys import first_per_key
from pressmill.schema import ARCHIVE_RECORD, extended

PLAUSIBLE_ARTICLES = 20
_SCHEMA = extended(ARCHIVE_RECORD, "day date, source_slug string")


def write_days(records: DataFrame, root: str) -> None:
    """Replaces every (day, source) that ``records(..., day, source)`` has, and no other."""
    rows = records.withColumn("source_slug", slug(F.col("source"))).select(*_SCHEMA.names)
    dealt = rows.repartition("day", "source_slug")
    out = dealt.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", "gzip")
    out.partitionBy("day", "source_slug").json(root)


def exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def read_archive(spark: SparkSession, root: str, days: Column | None = None) -> DataFrame:
    """All records, or those of ``days``; an archive that does not exist yet is empty. A broken file gives what comes before its break.

    A file that ends early gives the lines that can be unpacked. Files with a line that is no JSON are listed
    first; they alone are read line by line, each in one task as compressed files are, up to that line.
    """
    if not exists(spark, root):
        return spark.createDataFrame([], _SCHEMA)
    read = spark.read.option("ignoreCorruptFiles", True).option("basePath", root)
    whole = read.schema(extended(_SCHEMA, "_broken string")).option("columnNameOfCorruptRecord", "_broken").json(root)
    whole = whole if days is None else whole.where(days)
    # a row for each broken file; the address is asked for because Spark does not read the broken text alone
    listed = whole.groupBy(F.col("_metadata.file_path").alias("f")).agg(F.max("_broken").alias("b"), F.max("url").alias("u")).where("b is not null")
    broken = [r["f"] for r in listed.collect()]
    if not broken:
        return whole.drop("_broken")
    sound = whole.where(~F.col("_metadata.file_path").isin(broken)).drop("_broken")
    lines = read.schema("value string, day date, source_slug string").text(broken)
    lines = lines.select("*", F.col("_metadata.file_path").alias("f"), F.monotonically_increasing_id().alias("n"))
    lines = lines.withColumn("r", F.from_json("value", extended(ARCHIVE_RECORD, "_broken string"), {"columnNameOfCorruptRecord": "_broken"}))
    bad = F.max(F.col("r._broken").isNotNull().cast("int")).over(Window.partitionBy("f").orderBy("n"))
    before = lines.withColumn("bad", bad).where("bad = 0 and trim(value) <> ''")
    return sound.unionByName(before.select(*[F.col(f"r.{n}") for n in ARCHIVE_RECORD.names], "day", "source_slug"))


def read_range(spark: SparkSession, root: str, first: str, last: str, sources: list[str] | None = None) -> DataFrame:
    """Records of the days (by partition, not by publication time) and, if given, of the sources by name."""
    rows = read_archive(spark, root, F.col("day").between(F.lit(first).cast("date"), F.lit(last).cast("date")))
    return rows.where(F.array_contains(F.array(*[slug(F.lit(s)) for s in sources]), F.col("source_slug"))) if sources else rows


def read_source_day(spark: SparkSession, root: str, day: str, source_slug: str) -> DataFrame:
    """One (day, source), all or nothing: a line that is no JSON empties the result."""
    if not exists(spark, root):
        return spark.createDataFrame([], _SCHEMA)
    lines = spark.read.schema("value string, day date, source_slug string").text(root)
    own = lines.where((F.col("day") == F.lit(day).cast("date")) & (F.col("source_slug") == source_slug)).where(F.trim("value") != "")
    options = {"columnNameOfCorruptRecord": "_broken"}
    own = own.withColumn("r", F.from_json("value", extended(ARCHIVE_RECORD, "_broken string"), options))
    broken = own.agg(F.coalesce(F.bool_or(F.col("r._broken").isNotNull()), F.lit(False)).alias("any_broken"))
    fields = [F.col(f"r.{n}") for n in ARCHIVE_RECORD.names]
    return own.crossJoin(F.broadcast(broken)).where("not any_broken").select(*fields, "day", "source_slug")


def stored_days(records: DataFrame) -> DataFrame:
    return records.select("day").distinct().orderBy("day")


def day_counts(records: DataFrame) -> DataFrame:
    return records.groupBy("day", "source").agg(F.count("*").alias("articles"))


def missing_days(days: DataFrame, day_col: str = "day") -> DataFrame:
    """Days between the first and the last that are not there.

    Each day looks at the next one, so only gaps are expanded.
    """
    one = days.select(F.col(day_col).alias("day")).distinct()
    following = F.lead("day").over(Window.orderBy("day"))  # a row for each day of the archive
    gaps = one.withColumn("next", following).where(F.date_diff("next", "day") > 1)
    return gaps.select(F.explode(F.sequence(F.date_add("day", 1), F.date_sub("next", 1))).alias("day"))


def status(records: DataFrame) -> DataFrame:
    """One row: days, first_day, last_day, articles, missing (array)."""
    days = records.groupBy("day").agg(F.count("*").alias("n"))
    total = days.agg(F.count("*").alias("days"), F.min("day").alias("first_day"), F.max("day").alias("last_day"), F.sum("n").alias("articles"))
    gaps = missing_days(days).agg(F.array_sort(F.collect_list("day")).alias("missing"))
    return total.crossJoin(F.broadcast(gaps))


def stored_bytes(spark: SparkSession, root: str) -> DataFrame:
    """One row ``bytes``: what the archive's files take."""
    files = read_archive(spark, root).select(F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_size").alias("s")).distinct()
    return files.agg(F.coalesce(F.sum("s"), F.lit(0)).alias("bytes"))


def harvest(found: DataFrame, stored: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(records to write, counters by source)`` of a harvest of ``found`` records of some days.

    Stored records win; of records found more than once one counts; of those found only addresses that their day and source do not hold are
    new; blank text is a failure. A day is written whole, so running twice changes nothing.
    """
    key = ["day", "source", "url"]
    held = stored.select(*key).distinct().withColumn("_held", F.lit(True))
    once = first_per_key(found, key, [F.asc(F.xxhash64(*[F.col(c).cast("string") for c in found.columns]))])
    marked = once.join(held, key, "left")
    blank = F.trim(F.coalesce(F.col("text"), F.lit(""))) == ""
    counters = marked.groupBy("source").agg(
        F.count("*").alias("articles"),
        F.count_if(F.col("_held")).alias("skipped"),
        F.count_if(F.col("_held").isNull() & ~blank).alias("new"),
        F.count_if(F.col("_held").isNull() & blank).alias("failed"),
    )
    fresh = marked.where(F.col("_held").isNull() & ~blank).select(*found.columns)
    touched = fresh.select("day", "source").distinct()
    return stored.join(touched, ["day", "source"], "left_semi").select(*found.columns).unionByName(fresh), counters


def plausible(counters: DataFrame) -> DataFrame:
    """One row ``(articles, ok)``: a day with next to nothing means a broken harvest."""
    return counters.agg(F.coalesce(F.sum(F.col("new") + F.col("skipped")), F.lit(0)).alias("articles")).withColumn("ok", F.col("articles") >= PLAUSIBLE_ARTICLES)


def merged_status(last: DataFrame, run: DataFrame) -> DataFrame:
    """One row: a harvest's outcome laid over the last one's.

    ``run`` is ``(day, finished, articles, ok)``; what says when the harvest last succeeded changes
    only if it did.
    """
    old = last.select(F.col("last_success").alias("_s"), F.col("last_success_day").alias("_d"))
    out = run.join(old, F.lit(True), "left")
    return out.select(
        F.when(F.col("ok"), F.col("finished")).otherwise(F.col("_s")).alias("last_success"),
        F.when(F.col("ok"), F.col("day")).otherwise(F.col("_d")).alias("last_success_day"),
        F.col("finished").alias("last_run"), F.col("day").alias("last_run_day"),
        F.col("articles").alias("last_run_articles"), F.col("ok").alias("last_run_ok"),
    )
