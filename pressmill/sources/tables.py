"""Tables by name, and articles as a view of the documents table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{root}/{name}.parquet")


def articles(spark: SparkSession, root: str) -> DataFrame:
    """Documents as articles: address, title and time follow from the id and the first line."""
    docs = table(spark, root, "documents")
    return docs.select(
        "doc_id",
        F.concat(F.lit("https://example.test/"), "source", F.lit("/"), F.col("doc_id").cast("string")).alias("url"),
        "source",
        F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(cast(doc_id % 30 as int), 0, cast(doc_id * 37 % 1440 as int), 0)").alias("published"),
        F.substring_index("text", "\n", 1).alias("title"),
        "text",
        "lang",
    )
