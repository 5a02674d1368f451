"""Sitemaps: the registry of sources, dated addresses, XML, and discovery over a table of pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pressmill.functions.text import parse_time
from pressmill.operators.keys import last_per_key
from pressmill.operators.match import in_sections, nested_included, worth_walking
from pressmill.schema import SOURCE
from pressmill.storage import written

MAX_SITEMAPS = 60
#: strftime directives of dated sitemaps, as Spark writes them.
_DIRECTIVES = {"%d": "dd", "%m": "MM", "%Y": "yyyy", "%y": "yy", "%H": "HH", "%j": "DDD"}
_NEWS = "struct<publication_date: string, title: string, keywords: string, language: string>"
_ENTRIES = f"array<struct<loc: string, lastmod: string, news: {_NEWS}>>"
#: The sources that are monitored by default, as rows of ``SOURCE``.
DEFAULT_SOURCES = [
    ("ABP Live", "hi/en", None, "https://www.abplive.com/news-%d-%m-%Y.xml", ["maharashtra", "politics", "india", "states"], []),
    ("ABP Majha", "mr", "https://marathi.abplive.com/news-sitemap.xml", None, ["maharashtra", "politics", "india", "states"], []),
    ("Maharashtra Times", "mr", "https://maharashtratimes.com/staticsitemap/mt/news/sitemap-48hours.xml", None, [], []),
    ("Loksatta", "mr", "https://www.loksatta.com/news-sitemap.xml", None, [], []),
    ("eSakal", "mr", "https://www.esakal.com/news_sitemap.xml", None, [], []),
    ("Lokmat", "mr", "https://www.lokmat.com/sitemap.xml", None, [], []),
    ("Sarkarnama", "mr", "https://www.sarkarnama.in/news_sitemap.xml", None, [], []),
    ("Saam TV", "mr", "https://www.saamtv.com/news_sitemap.xml", None, [], []),
    ("TV9 Marathi", "mr", "https://www.tv9marathi.com/news-sitemap.xml", None, [], []),
    ("News18 Marathi", "mr", "https://news18marathi.com/commonfeeds/v1/mar/sitemap/google-news.xml", None, [], []),
    ("Pudhari", "mr", "https://pudhari.news/news_sitemap.xml", "https://pudhari.news/sitemap/sitemap-daily-%Y-%m-%d.xml", [], []),
    ("Navarashtra", "mr", "https://www.navarashtra.com/news-sitemap.xml", None, [], []),
    ("Lokshahi", "mr", "https://lokshahilive.com/post-sitemap1.xml", None, [], []),
    ("Tarun Bharat", "mr", "https://www.tarunbharat.com/sitemap.xml", None, [], ["post-sitemap"]),
    ("Navbharat Times", "hi", "https://navbharattimes.indiatimes.com/staticsitemap/nbt/news/sitemap-48hours.xml", None, ["maharashtra", "politics", "india", "states"], []),
    ("Times Now", "en", "https://www.timesnownews.com/google-news-sitemap-en.xml", None, ["maharashtra", "politics", "india", "states"], []),
    ("NDTV", "en", "https://www.ndtv.com/sitemap/google-news-sitemap", None, ["maharashtra", "politics", "india", "states"], []),
    ("NDTV Marathi", "mr", "https://marathi.ndtv.com/sitemap/google-news-sitemap", None, [], []),
]


def default_sources(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(DEFAULT_SOURCES, SOURCE)


def spark_pattern(template: str) -> str:
    """A strftime address template as a pattern of ``date_format``."""
    out, literal, at = [], "", 0
    while at < len(template):
        directive = template[at : at + 2]
        if directive in _DIRECTIVES:
            if literal:
                out.append("'" + literal.replace("'", "''") + "'")
            out.append(_DIRECTIVES[directive])
            literal, at = "", at + 2
        else:
            literal, at = literal + template[at], at + 1
    if literal:
        out.append("'" + literal.replace("'", "''") + "'")
    return "".join(out)


def dated_sitemaps(days: DataFrame, day_col: str, template: str) -> DataFrame:
    """``(day, sitemap)`` for every day of a frame."""
    return days.select(F.col(day_col).alias("day"), F.date_format(day_col, spark_pattern(template)).alias("sitemap"))


def days_between(spark: SparkSession, first: str, last: str) -> DataFrame:
    return spark.range(1).select(F.explode(F.sequence(F.lit(first).cast("date"), F.lit(last).cast("date"))).alias("day"))


def _plain(xml: Column) -> Column:
    """Without name spaces, so that prefixed and plain elements are alike."""
    xml = F.regexp_replace(xml, r"\s+xmlns(?::[\w.-]+)?\s*=\s*(?:\"[^\"]*\"|'[^']*')", "")
    return F.regexp_replace(xml, r"(</?)[\w.-]+:", "$1")


def sitemap_entries(sitemaps: DataFrame, xml_col: str = "xml") -> DataFrame:
    """Keeps the other columns, adds ``kind`` (index, url), ``loc``, ``lastmod``, ``published``, ``title``, ``keywords``, ``language`` and
    ``position``, the place in the document.

    A document with a sitemap index gives only its entries. Blank addresses are left out; an
    unreadable publication date gives way to the date of change.
    """
    kept = [c for c in sitemaps.columns if c != xml_col]
    xml = _plain(F.col(xml_col).cast("string"))
    is_index = xml.contains("<sitemapindex")
    read = F.from_xml(xml, f"sitemap {_ENTRIES}, url {_ENTRIES}")
    read = sitemaps.select(*kept, is_index.alias("_index"), read.alias("_xml"))
    entries = F.when(F.col("_index"), F.col("_xml.sitemap")).otherwise(F.col("_xml.url"))
    rows = read.select(*kept, F.when(F.col("_index"), "index").otherwise("url").alias("kind"), F.posexplode_outer(entries).alias("position", "e"))
    blank = lambda c: F.coalesce(F.trim(c), F.lit(""))
    return rows.where(blank(F.col("e.loc")) != "").select(
        *kept, "kind", F.trim("e.loc").alias("loc"), parse_time(F.col("e.lastmod")).alias("lastmod"),
        F.coalesce(parse_time(F.col("e.news.publication_date")), parse_time(F.col("e.lastmod"))).alias("published"),
        blank(F.col("e.news.title")).alias("title"), blank(F.col("e.news.keywords")).alias("keywords"), blank(F.col("e.news.language")).alias("language"), "position",
    )


def language_or(own: Column, default: Column) -> Column:
    """A record's language, or its source's where it names none."""
    return F.when(own != "", own).otherwise(default)


def discover(sources: DataFrame, pages: DataFrame, first: str, last: str) -> DataFrame:
    """``(source, url, published, title, keywords, language, at)``: candidates in the window.

    ``pages`` is ``(url, xml)``, what a crawler has stored. Sitemaps are walked level by level
    from each source's dated addresses and index, for all sources at once, and within a level in the order in which
    they were enlisted; a sitemap is read once for each source, and a source's walk stops enlisting after
    ``MAX_SITEMAPS``. Of equal addresses of a source the last record read counts.
    """
    lo, hi = F.lit(first).cast("date").cast("timestamp"), F.lit(last).cast("date").cast("timestamp") + F.expr("interval '23:59:59' hour to second")
    days = F.explode(F.sequence(F.lit(first).cast("date"), F.lit(last).cast("date")))
    dated = [
        sources.where(F.col("dated_sitemap") == r[0]).select("name", days.alias("day")).select("name", F.date_format("day", spark_pattern(r[0])).alias("sitemap"), F.date_format("day", "yyyyMMdd").cast("long").alias("nth"))
        for r in sources.where("dated_sitemap is not null").select("dated_sitemap").distinct().collect()
    ]  # one for each registered source at most
    level = sources.where("sitemap_index is not null").select("name", F.col("sitemap_index").alias("sitemap"), F.lit(-1).cast("long").alias("nth"))
    for d in dated:
        level = d.unionByName(level)
    level = level.groupBy("name", "sitemap").agg(F.min("nth").alias("nth")).withColumn("depth", F.lit(0))
    seen, found, depth = level, [], 0
    rules = sources.select("name", "sections", "nested_include", F.col("language").alias("own_language"))
    while depth < MAX_SITEMAPS and not level.isEmpty():
        read = sitemap_entries(level.join(pages.withColumnRenamed("url", "sitemap"), "sitemap").select("name", "sitemap", "depth", "nth", "xml"))
        read = written(read.join(F.broadcast(rules), "name"), "sitemaps")
        urls = read.where("kind = 'url' and published is not null").where(F.col("published").between(lo, hi)).where(in_sections(F.col("loc"), F.col("sections")))
        language = language_or(F.col("language"), F.col("own_language"))
        found.append(urls.select(F.col("name").alias("source"), F.col("loc").alias("url"), "published", "title", "keywords", language.alias("language"), "depth", "nth", "position"))
        nested = read.where("kind = 'index'").where(nested_included(F.col("loc"), F.col("nested_include"))).where(worth_walking(F.col("lastmod"), lo, hi))
        visited = seen.groupBy("name").agg(F.count("*").alias("visited")).where(F.col("visited") < MAX_SITEMAPS)
        nested = nested.join(visited, "name", "left_semi").groupBy("name", F.col("loc").alias("sitemap")).agg(F.min(F.struct("nth", "position")).alias("at"))
        nested = nested.join(seen, ["name", "sitemap"], "left_anti")
        nth = F.row_number().over(Window.partitionBy("name").orderBy("at", "sitemap")).cast("long")  # a source's sitemaps of one level
        depth += 1
        # each level is a table, which cuts the growing lineage
        level = written(nested.select("name", "sitemap", nth.alias("nth"), F.lit(depth).alias("depth")), "level")
        seen = seen.unionByName(level)
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return last_per_key(out, ["source", "url"], ["depth", "nth", "position"]).drop("depth", "nth", "position")
