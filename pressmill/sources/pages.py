"""Pages that a crawler has stored, and what robots files let it fetch."""

from __future__ import annotations

import gzip
from collections.abc import Iterator
from urllib.robotparser import RobotFileParser

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, DoubleType, StringType, StructField, StructType

from pressmill.functions.text import page_key, url_host

AGENT = "*"
DELAY = 2.0


@F.pandas_udf(BinaryType())
def _unzipped(data: pd.Series) -> pd.Series:
    def one(d: bytes | None) -> bytes | None:
        try:
            return d if d is None or d[:2] != b"\x1f\x8b" else gzip.decompress(d)
        except (OSError, EOFError):
            return None

    return data.map(one)


def cached_pages(spark: SparkSession, folder: str, urls: DataFrame) -> DataFrame:
    """``(url, html)`` of the addresses whose page is in the cache, a file each named by ``page_key``.

    A file of an address ending in ``.gz`` is unpacked; one that cannot be is null. Only the files'
    names meet the addresses; contents are read of the files that match.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.bin").load(folder)
    files = files.select(F.regexp_extract("path", r"([0-9a-f]{32})\.bin$", 1).alias("key"), "content")
    wanted = urls.select("url").distinct().withColumn("key", page_key(F.col("url")))
    found = files.join(wanted, "key").select("url", "content")
    packed = F.lower("url").endswith(".gz")
    body = F.when(packed, _unzipped(F.when(packed, F.col("content")))).otherwise(F.col("content"))
    return found.select("url", F.decode(body, "UTF-8").alias("html"))


_RULES = StructType([StructField("url", StringType()), StructField("host", StringType()), StructField("robots", StringType())])
_VERDICT = StructType([*_RULES.fields[:2], StructField("delay", DoubleType())])


def allowed(urls: DataFrame, robots: DataFrame, agent: str = AGENT, delay: float = DELAY) -> DataFrame:
    """``(url, host, delay)`` of the addresses that their host's robots file lets the agent fetch.

    ``robots`` is ``(host, robots)``, one row for each host; a host without one, or with an
    unreadable (null) one, allows all. The delay is the greater of ours and the host's. Each
    batch parses a host's file once.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            keep, delays = [], []
            for text, group in b.groupby(b["robots"].fillna(""), sort=False):
                rules = RobotFileParser()
                rules.parse(text.splitlines())
                own = float(rules.crawl_delay(agent) or 0)
                for at, url in group["url"].items():
                    if rules.can_fetch(agent, url):
                        keep.append(at)
                        delays.append(max(delay, own))
            yield b.loc[keep, ["url", "host"]].assign(delay=delays)

    rows = urls.select("url", url_host(F.col("url")).alias("host")).join(robots.select("host", "robots"), "host", "left")
    return rows.select("url", "host", "robots").mapInPandas(run, _VERDICT)
