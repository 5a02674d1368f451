import datetime as dt

import pytest
from pyspark.sql import functions as F

from pressmill.operators import keys, match


def matched(spark, text, keywords):
    df = spark.createDataFrame([(text,)], "x string")
    return df.select(match.matched_keywords(F.col("x"), keywords)).first()[0]


@pytest.mark.parametrize(
    "text,keyword,hit",
    [
        ("xfadnavis", "fadnavis", False),
        ("(Fadnavis)", "fadnavis", True),
        ("éfadnavis", "fadnavis", True),
        ("फडणवीसांनी", "फडणवीस", True),
        ("any text", " ", True),
        ("STRASSE", "straße", True),
        ("a+b", "a+b", True),
        ("aab", "a+b", False),
        ("x \\E y", "x \\E y", True),
        (None, "a", False),
        ("text", "", False),
    ],
)
def test_one_keyword(spark, text, keyword, hit):
    assert matched(spark, text, [keyword]) == ([keyword] if hit else [])


def test_list_order_and_spelling(spark):
    assert matched(spark, "beta Alpha", ["ALPHA", "gamma", "beta", "ALPHA"]) == ["ALPHA", "beta", "ALPHA"]
    assert matched(spark, "x", []) == []


def test_location(spark):
    df = spark.createDataFrame([("About thing", "x"), ("None", "a thing"), ("None", "x")], "t string, b string")
    assert [r[0] for r in df.select(match.match_location(F.col("t"), F.col("b"), ["thing"])).collect()] == ["title/slug", "body", None]


def test_live_pages(spark):
    df = spark.createDataFrame([("http://h/X-Live-y", ""), ("http://h/a", "News LIVE today"), ("http://h/alive-y", "news")], "u string, t string")
    assert [r[0] for r in df.select(match.is_live_page(F.col("u"), F.col("t"))).collect()] == [True, True, False]


def test_window_edges(spark):
    times = [dt.datetime(2024, 1, 5, 23, 59, 59), dt.datetime(2024, 1, 5, 23, 59, 59, 500000), dt.datetime(2024, 1, 6), dt.datetime(2024, 1, 5), None]
    df = spark.createDataFrame([(t,) for t in times], "p timestamp_ntz")
    day = F.lit("2024-01-05").cast("date")
    assert [r[0] for r in df.select(match.in_window(F.col("p"), day, day)).collect()] == [True, False, False, True, False]


def test_sections_and_nested(spark):
    df = spark.createDataFrame([("http://H/India/x", ["india"]), ("http://h/x", ["india"]), ("http://h/x", []), ("http://h/x", None)], "u string, s array<string>")
    assert [r[0] for r in df.select(match.in_sections(F.col("u"), F.col("s"))).collect()] == [True, False, True, True]
    assert [r[0] for r in df.select(match.nested_included(F.col("u"), F.col("s"))).collect()] == [False, False, True, True]


def test_worth_walking(spark):
    t = dt.datetime
    df = spark.createDataFrame([(None,), (t(2024, 1, 1),), (t(2024, 1, 5),), (t(2024, 1, 7),), (t(2024, 1, 7, 0, 0, 1),)], "m timestamp_ntz")
    lo, hi = (F.lit(x).cast("timestamp_ntz") for x in ("2024-01-05", "2024-01-06"))
    assert [r[0] for r in df.select(match.worth_walking(F.col("m"), lo, hi)).collect()] == [True, False, True, True, False]


def test_keys(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("b", 3, "z")], "k string, n int, v string")
    assert sorted(r["v"] for r in keys.first_per_key(df, "k", [F.asc("n")]).collect()) == ["x", "z"]
    assert sorted(r["v"] for r in keys.last_per_key(df, "k", ["n"]).collect()) == ["y", "z"]
    new = spark.createDataFrame([("a", 0, "new"), ("c", 9, "c2"), ("c", 8, "c1")], "k string, n int, v string")
    assert sorted(r["v"] for r in keys.append_keep_first(df, new, "k", [F.asc("n")]).collect()) == ["c1", "x", "z"]
