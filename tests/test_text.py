import datetime as dt

import pytest
from pyspark.sql import functions as F

from pressmill.functions import text as T


def values(spark, column, rows, schema="x string"):
    df = spark.createDataFrame([(r,) for r in rows], schema)
    return [r[0] for r in df.select(column(F.col("x"))).collect()]


def test_normalise_folds_and_composes(spark):
    assert values(spark, T.normalise, ["STRASSE", "straße", "É", "ΟΔΟΣ", None, "ABC"]) == ["strasse", "strasse", "é", "οδοσ", "", "abc"]


def test_word_count_is_by_white_space(spark):
    assert values(spark, T.word_count, ["", None, " a b\tc\n", "a\x1cb", "one"]) == [0, 0, 3, 2, 1]


def test_tokens_part_at_vowel_signs(spark):
    assert values(spark, T.tokens, ["फडणवीस", "A_b 1-2 É", ""]) == [["फडणव", "स"], ["a_b", "1", "2", "é"], []]


@pytest.mark.parametrize(
    "url,words,path,host",
    [
        ("https://a.b.com:8080/News/Some_Title-1.html?q=1#f", " news some title 1 html", "/News/Some_Title-1.html", "a.b.com"),
        ("http://a b/c;x=1", " c", "/c", "a b"),
        ("no scheme/x", "no scheme x", "no scheme/x", ""),
        ("http://h/मराठी/%E0%A4", " e0 a4", "/मराठी/%E0%A4", "h"),
    ],
)
def test_addresses(spark, url, words, path, host):
    assert values(spark, T.slug_words, [url]) == [words]
    assert values(spark, T.url_path, [url]) == [path]
    assert values(spark, T.url_host, [url]) == [host]


def test_slug_and_page_key(spark):
    assert values(spark, T.slug, ["TV9 Marathi", "--A  b!", "मराठी"]) == ["tv9-marathi", "a-b", ""]
    assert len(values(spark, T.page_key, ["http://x"])[0]) == 32


def test_times(spark):
    spark.conf.set("spark.sql.session.timeZone", "+05:30")
    try:
        given = ["2026-08-30T10:00:00", "2026-08-30T20:00:00Z", "2026-08-30T10:00Z", "20260830", "2026-08-30", "Sun, 30 Aug 2026 10:00:00 GMT", "", None, "2026-13-01"]
        got = values(spark, lambda c: F.date_format(T.parse_time(c), "yyyy-MM-dd HH:mm"), given)
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert got == ["2026-08-30 10:00", "2026-08-31 01:30", "2026-08-30 15:30", "2026-08-30 00:00", "2026-08-30 00:00", None, None, None, None]


def test_minute_sigmoid_fence_braces(spark):
    assert values(spark, T.minute, [dt.datetime(2024, 1, 2, 3, 4, 59), None], "x timestamp_ntz") == ["2024-01-02 03:04", ""]
    assert values(spark, T.sigmoid, [0.0, -1000.0, 1000.0], "x double") == [0.5, 0.0, 1.0]
    assert values(spark, T.unfenced, ["```markdown\n# A\n```", "# B"]) == ["# A", "# B"]
    assert values(spark, T.template_safe, ["a {b} c"]) == ["a {{b}} c"]


def test_window_text(spark):
    df = spark.createDataFrame([("08/01/2026", "08/31/2026"), ("soon", "08/31/2026")], "a string, b string")
    got = [r[0] for r in df.select(T.window_text(F.col("a"), F.col("b"))).collect()]
    assert got == ["1 ऑगस्ट 2026 ते 31 ऑगस्ट 2026 (2026-08-01 – 2026-08-31)", "soon – 08/31/2026"]
