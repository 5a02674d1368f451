"""The nightly harvest as a stream: new records, each address once, kept by day."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from pressmill.functions.text import slug
from pressmill.sources.archive import harvest, read_archive, write_days
from pressmill.storage import written

LATENESS = "2 days"


def daily_counts(records: DataFrame, time_col: str, kind_col: str, value_col: str, lateness: str = LATENESS) -> DataFrame:
    """``(day, kind, n, total)`` by event time; a day is final once ``lateness`` has passed it."""
    timed = records.withWatermark(time_col, lateness)
    day = F.window(time_col, "1 day")
    out = timed.groupBy(day, kind_col).agg(F.count("*").alias("n"), F.sum(value_col).alias("total"))
    return out.select(F.col("window.start").cast("date").alias("day"), F.col(kind_col).alias("kind"), "n", "total")


def unique_records(records: DataFrame, key: str, time_col: str, lateness: str = LATENESS) -> DataFrame:
    """The first record of each key within the watermark; state is dropped behind it."""
    return records.withWatermark(time_col, lateness).dropDuplicatesWithinWatermark([key])


def archive_stream(records: DataFrame, root: str, checkpoint: str) -> StreamingQuery:
    """Merges a stream of records ``(..., day, source, url, text)`` into the archive, all there is now.

    Each batch rewrites the (day, source) partitions it has news for; run again, it changes nothing.
    """

    def merge(batch: DataFrame, _: int) -> None:
        spark: SparkSession = batch.sparkSession
        # the days and sources of the batch alone: pruned by partition
        touched = batch.select("day", slug(F.col("source")).alias("source_slug")).distinct()
        stored = read_archive(spark, root).join(F.broadcast(touched), ["day", "source_slug"], "left_semi").select(*batch.columns)
        whole, _counters = harvest(batch.dropDuplicates(["day", "source", "url"]), stored)
        write_days(written(whole, "staged"), root)  # aside first: the archive is read while it is replaced

    return records.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

