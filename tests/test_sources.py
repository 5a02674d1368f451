import gzip
import datetime as dt

from pyspark.sql import functions as F

from pressmill.operators import report
from pressmill.schema import PROFILE, RUN_META, SOURCE
from pressmill.sources import archive, registry, sitemap
from pressmill.streaming import daily

RECORD = "url string, source string, language string, title string, published string, text string, words long, fetched string, day date"


def records(spark, rows):
    full = [(u, s, "en", "t", None, x, 1, "", dt.date.fromisoformat(d)) for u, s, x, d in rows]
    return spark.createDataFrame(full, RECORD)


def test_archive_is_replaced_by_day_and_source(spark, tmp_path):
    root = str(tmp_path / "a")
    assert archive.read_archive(spark, root).count() == 0
    archive.write_days(records(spark, [("u1", "A B", "x", "2024-01-01"), ("u2", "C", "x", "2024-01-01"), ("u3", "C", "x", "2024-01-03")]), root)
    archive.write_days(records(spark, [("u9", "C", "y", "2024-01-01")]), root)
    got = archive.read_range(spark, root, "2024-01-01", "2024-01-02").collect()
    assert sorted((r["url"], r["source_slug"]) for r in got) == [("u1", "a-b"), ("u9", "c")]
    assert archive.read_range(spark, root, "2024-01-01", "2024-01-09", ["c"]).count() == 2
    status = archive.status(archive.read_archive(spark, root)).first()
    assert (status["days"], status["articles"], status["missing"]) == (2, 3, [dt.date(2024, 1, 2)])
    assert archive.stored_bytes(spark, root).first()["bytes"] > 0
    assert [r["day"].day for r in archive.stored_days(archive.read_archive(spark, root)).collect()] == [1, 3]


def test_broken_lines(spark, tmp_path):
    folder = tmp_path / "a" / "day=2024-01-01" / "source_slug=c"
    folder.mkdir(parents=True)
    with gzip.open(folder / "part.json.gz", "wt") as f:
        f.write('{"url": "u1", "source": "C"}\n{"url": \n{"url": "u2", "source": "C"}\n')
    root = str(tmp_path / "a")
    other = tmp_path / "a" / "day=2024-01-01" / "source_slug=d"
    other.mkdir()
    with gzip.open(other / "part.json.gz", "wt") as f:
        f.write('{"url": "u3", "source": "D"}\n')
    # a broken file ends at its break, the others are whole
    assert sorted((r["url"], r["source_slug"]) for r in archive.read_range(spark, root, "2024-01-01", "2024-01-01").collect()) == [("u1", "c"), ("u3", "d")]
    assert archive.read_source_day(spark, root, "2024-01-01", "c").collect() == []
    with gzip.open(folder / "part.json.gz", "wt") as f:
        f.write('{"url": "u1", "source": "C"}\n\n{"url": "u2", "source": "C"}\n')
    assert sorted(r["url"] for r in archive.read_source_day(spark, root, "2024-01-01", "c").collect()) == ["u1", "u2"]
    assert archive.read_source_day(spark, root, "2024-01-02", "c").collect() == []


def test_missing_days(spark):
    days = spark.createDataFrame([(dt.date(2024, 1, d),) for d in (1, 2, 5)], "day date")
    assert sorted(r["day"].day for r in archive.missing_days(days).collect()) == [3, 4]


def test_harvest_of_repeated_records(spark):
    found = records(spark, [("u1", "C", "x", "2024-01-01"), ("u1", "C", "x", "2024-01-01"), ("u2", "C", "y", "2024-01-01")])
    stored = records(spark, [("u2", "C", "y", "2024-01-01"), ("u2", "C", "y", "2024-01-01")])
    whole, counters = archive.harvest(found, stored)
    c = counters.first()
    assert (c["articles"], c["new"], c["skipped"]) == (2, 1, 1)
    assert sorted(r["url"] for r in whole.collect()) == ["u1", "u2", "u2"]


def test_harvest_twice_changes_nothing(spark, tmp_path):
    root = str(tmp_path / "a")
    found = records(spark, [(f"u{k}", "C", "" if k == 3 else "x", "2024-01-01") for k in range(30)])
    for new, skipped in ((29, 0), (0, 29)):
        stored = archive.read_archive(spark, root).select(*found.columns)
        whole, counters = archive.harvest(found, stored)
        c = counters.first()
        assert (c["articles"], c["new"], c["skipped"], c["failed"]) == (30, new, skipped, 1)
        assert archive.plausible(counters).first()["ok"]
        from pressmill.storage import written

        archive.write_days(written(whole, "t"), root)
        assert archive.read_archive(spark, root).count() == 29


def test_stream_into_the_archive(spark, tmp_path):
    root, staged = str(tmp_path / "a"), str(tmp_path / "in")
    rows = records(spark, [("u1", "C", "x", "2024-01-01"), ("u1", "C", "x", "2024-01-01"), ("u2", "D", "x", "2024-01-02")])
    for _ in range(2):
        rows.write.mode("append").parquet(staged)
        stream = spark.readStream.schema(RECORD).parquet(staged)
        daily.archive_stream(stream, root, str(tmp_path / "state")).awaitTermination()
        assert sorted(r["url"] for r in archive.read_archive(spark, root).collect()) == ["u1", "u2"]


def test_sitemap_entries(spark):
    xml = """<urlset xmlns="a" xmlns:news="b"><url><loc> http://h/1 </loc><lastmod>2026-08-30</lastmod><news:news><news:publication_date>bad</news:publication_date>
    <news:title> T </news:title></news:news></url><url><loc> </loc></url><url><loc>http://h/2</loc></url></urlset>"""
    index = "<sitemapindex><sitemap><loc>http://h/s</loc></sitemap></sitemapindex>"
    df = spark.createDataFrame([("x", xml), ("y", index), ("z", None), ("w", "no xml")], "name string, xml string")
    got = sitemap.sitemap_entries(df).orderBy("loc").collect()
    assert [(r["kind"], r["loc"], r["title"], None if r["published"] is None else r["published"].day) for r in got] == [
        ("url", "http://h/1", "T", 30), ("url", "http://h/2", "", None), ("index", "http://h/s", "", None)
    ]


def test_discovery(spark):
    loc = lambda u, t, lm="2024-01-05T10:00:00": f"<url><loc>{u}</loc><lastmod>{lm}</lastmod><news><title>{t}</title></news></url>"
    pages = [
        ("http://a/index.xml", "<sitemapindex><sitemap><loc>http://a/post-1.xml</loc><lastmod>2024-01-05</lastmod></sitemap>"
         "<sitemap><loc>http://a/post-old.xml</loc><lastmod>2023-01-01</lastmod></sitemap><sitemap><loc>http://a/tag-1.xml</loc></sitemap>"
         "<sitemap><loc>http://a/index.xml</loc></sitemap></sitemapindex>"),
        ("http://a/post-1.xml", f"<urlset>{loc('http://a/india/1', 'one')}{loc('http://a/x', 'off')}{loc('http://a/india/2', 'late', '2024-02-01')}</urlset>"),
        ("http://a/post-old.xml", f"<urlset>{loc('http://a/india/9', 'old')}</urlset>"),
        ("http://a/tag-1.xml", f"<urlset>{loc('http://a/india/8', 'tag')}</urlset>"),
        ("http://b/05-01-2024.xml", f"<urlset>{loc('http://b/1', 'first')}{loc('http://b/1', 'again', '2024-01-05T09:00:00')}</urlset>"),  # the last record counts, not the latest
    ]
    sources = [("A", "en", "http://a/index.xml", None, ["india"], ["post"]), ("B", "mr", None, "http://b/%d-%m-%Y.xml", [], [])]
    got = sitemap.discover(spark.createDataFrame(sources, SOURCE), spark.createDataFrame(pages, "url string, xml string"), "2024-01-04", "2024-01-06")
    assert sorted((r["source"], r["url"], r["title"], r["language"]) for r in got.collect()) == [
        ("A", "http://a/india/1", "one", "en"), ("B", "http://b/1", "again", "mr")
    ]


def test_default_sources(spark):
    rows = sitemap.default_sources(spark).collect()
    assert len(rows) == 18 and all(r["sitemap_index"] or r["dated_sitemap"] for r in rows)
    assert sitemap.spark_pattern("a'b-%d/%m") == "'a''b-'dd'/'MM"


def test_profiles(spark, tmp_path):
    rows = [("", " Some Name ", "s", [" a ", ""], " ", "t1", "t1"), ("", "", "s", ["a"], "b", "t1", "t1"), ("x", "N", "s", [" "], "b", "t1", "t1"), (None, "मराठी", "s", ["a"], "b", "t", "t")]
    got = registry.checked(spark.createDataFrame(rows, PROFILE)).orderBy("name").collect()
    assert [(r["id"], r["problem"]) for r in got] == [("", "no name"), ("x", "no terms"), ("some-name", None), ("", "no id")]
    stored = spark.createDataFrame([("a", "A", "s", ["t"], "", "c1", "u1"), ("b", "B", "s", ["t"], "own", "c2", "u1")], PROFILE)
    change = spark.createDataFrame([("b", "B2", "s", ["t"], "own", "c9", "u2"), ("c", "C", "s", ["t"], "", "c0", "u2")], PROFILE)
    path = str(tmp_path / "p")
    registry.save(registry.upserted(stored, change), path)
    assert [(r["id"], r["name"], r["created"]) for r in registry.load_profiles(spark, path).collect()] == [("c", "C", "c0"), ("a", "A", "c1"), ("b", "B2", "c2")]
    assert all(r["system_prompt"] for r in registry.load_profiles(spark, path).collect())
    assert registry.upserted(stored, change, replace_all=True).count() == 2
    left, was = registry.deleted(registry.load_profiles(spark, path), "a")
    assert was and left.count() == 2 and not registry.deleted(left, "zz")[1]


def test_run_meta_merges(spark):
    old = spark.createDataFrame([("r1", "running", "s", *[None] * 13)], RUN_META)
    new = spark.createDataFrame([("r1", "complete", *[None] * 14), ("r2", "empty", *[None] * 14)], RUN_META)
    merged = registry.merge_meta(old, new)
    runs = registry.list_runs(merged, spark.createDataFrame([("r2",)], "id string")).collect()
    assert [(r["id"], r["status"], r["subject"], r["has_report"]) for r in runs] == [("r2", "empty", None, True), ("r1", "complete", "s", False)]


def test_csv_bytes(spark, tmp_path):
    rows = spark.createDataFrame([("S", "2024-01-01 10:00", 'T "q"', "u", 0.123456, 7, "en", "x")], "source string, published string, title string, url string, relevance double, words long, lang string, extra string")
    report.write_csv(rows.coalesce(1), str(tmp_path / "c"))
    files = list((tmp_path / "c").glob("part-*"))
    data = files[0].read_bytes()
    assert len(files) == 1 and data.startswith(b'\xef\xbb\xbf"source","published"')
    assert b'"S","2024-01-01 10:00","T ""q""","u","0.1235","7","en"' in data


def test_registry_text(spark, tmp_path):
    (tmp_path / "r.md").write_text("# a\nb")
    spark.range(12).repartitionByRange(12, "id").selectExpr("concat(id + 1, ' article') as value").sortWithinPartitions("value").write.text(str(tmp_path / "parts"))
    assert registry.read_text(spark, str(tmp_path / "parts")) == "".join(f"{k} article\n" for k in range(1, 13))
    assert registry.read_text(spark, str(tmp_path / "r.md")) == "# a\nb" and registry.read_text(spark, str(tmp_path / "no")) is None


def test_page_cache(spark, tmp_path):
    import hashlib

    from pressmill.sources import pages

    for url, data in (("http://h/a", "<p>é</p>".encode()), ("http://h/s.xml.gz", gzip.compress(b"<urlset/>")), ("http://h/bad.gz", b"\x1f\x8bno"), ("http://h/other", b"x")):
        (tmp_path / f"{hashlib.sha256(url.encode()).hexdigest()[:32]}.bin").write_bytes(data)
    urls = spark.createDataFrame([(u,) for u in ("http://h/a", "http://h/s.xml.gz", "http://h/bad.gz", "http://h/none", "http://h/a")], "url string")
    got = {r["url"]: r["html"] for r in pages.cached_pages(spark, str(tmp_path), urls).collect()}
    assert got == {"http://h/a": "<p>é</p>", "http://h/s.xml.gz": "<urlset/>", "http://h/bad.gz": None}


def test_robots(spark):
    from pressmill.sources import pages

    urls = spark.createDataFrame([(u,) for u in ("http://a/x", "http://a/no/x", "http://b/no", "http://c/q")], "url string")
    robots = spark.createDataFrame([("a", "User-agent: *\nDisallow: /no\nCrawl-delay: 5"), ("b", None)], "host string, robots string")
    got = sorted(tuple(r) for r in pages.allowed(urls, robots).collect())
    assert got == [("http://a/x", "a", 5.0), ("http://b/no", "b", 2.0), ("http://c/q", "c", 2.0)]


def test_status_keeps_the_last_success(spark):
    none = spark.createDataFrame([], "last_success string, last_success_day string")
    run = lambda day, n, ok: spark.createDataFrame([(day, f"{day}T01", n, ok)], "day string, finished string, articles long, ok boolean")
    first = archive.merged_status(none, run("d1", 30, True))
    second = archive.merged_status(first, run("d2", 3, False)).first()
    assert (second["last_success_day"], second["last_run_day"], second["last_run_ok"]) == ("d1", "d2", False)


def test_prompt():
    import pytest

    assert report.prompt("a {b}", "h") == [("system", "a {{b}}"), ("human", "h")]
    with pytest.raises(ValueError):
        report.prompt(" ", "h")
