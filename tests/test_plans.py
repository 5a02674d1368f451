from pyspark.sql import functions as F

from pressmill.operators import rank, report
from pressmill.plans import corpus, live, search
from pressmill.sources.tables import articles
from pressmill.sources.tables import table


def test_search_first_passing(spark):
    rows = [("u", "short thing", "t", 1), ("u", "long enough thing " + "w " * 30, "t", 2), ("u", "thing " * 30, "t", 3), ("x-live-y", "thing " * 30, "t", 4), ("v", "nothing " * 30, None, 5)]
    df = spark.createDataFrame(rows, "url string, text string, title string, n int")
    got = search.search(df, ["thing"], [F.asc("n")]).collect()
    assert [(r["url"], r["n"], r["matched"]) for r in got] == [("u", 2, ["thing"])]
    assert search.search(df, [], [F.asc("n")]).count() == 2
    assert search.search(df, ["thing"], [F.asc("n")], drop_live_pages=False).count() == 2


def test_live_run(spark):
    body = "<article>" + "".join(f"<p>Paragraph {k} about the Subject of the day, long enough.</p>" for k in range(9)) + "</article>"
    pages = [("http://h/subject-one", f"<h1>Page title</h1>{body}"), ("http://h/two", f"<h1>Two</h1>{body}"), ("http://h/three", "<p>nothing here at all to be found</p>")]
    cand = [
        ("B", 1, 0, "http://h/subject-one", None, "", "", "en"), ("A", 0, 0, "http://h/two", None, "Two", "", "en"),
        ("A", 0, 1, "http://h/three", None, "Three", "", "en"), ("C", 2, 0, "http://h/two", None, "The subject", "", "en"),
        ("C", 2, 1, "http://h/live-news/subject", None, "x", "", "en"),
    ]
    c = spark.createDataFrame(cand, "source string, source_index int, position int, url string, published timestamp_ntz, title string, keywords string, language string")
    p = spark.createDataFrame(pages, "url string, html string")
    got = sorted((r["Links"], r["Source"], r["Title"], r["Matched In"]) for r in live.candidates_matched(c, p, ["subject"]).collect())
    assert got == [("http://h/subject-one", "B", "Page title", "title/slug"), ("http://h/two", "C", "The subject", "title/slug")]
    only = live.candidates_matched(c.where("source <> 'C'"), p, ["subject"])
    assert ("http://h/two", "body") in {(r["Links"], r["Matched In"]) for r in only.collect()}
    assert live.candidates_matched(c.where("source <> 'C'"), p, ["subject"], deep=False).count() == 1
    docs = live.documents(only, p, min_words=20).collect()
    assert {r["url"] for r in docs} == {"http://h/subject-one", "http://h/two"} and all(r["partial"] for r in docs)


def test_corpus(spark, sf_dir, tmp_path):
    docs = articles(spark, sf_dir).select("url", "source", F.date_format("published", "yyyy-MM-dd HH:mm").alias("published"), "title", "text", "lang", F.lit(False).alias("partial"))
    built = corpus.build_corpus(docs, "thing ering", floor=0.01)
    assert built.counts["extracted"] == docs.count() and built.counts["duplicates"] > 0
    rows = built.kept.orderBy("n").collect()
    assert [r["n"] for r in rows] == list(range(1, built.counts["kept"] + 1))
    assert [r["score"] for r in rows] == sorted((r["score"] for r in rows), reverse=True)
    corpus.write_run(built, str(tmp_path))
    assert spark.read.json(str(tmp_path / "articles")).count() == built.counts["ranked"]
    text = "\n".join(r[0] for r in spark.read.text(str(tmp_path / "corpus-text")).collect())
    assert text.count("=== ARTICLE ") == built.counts["kept"]


def test_long_bodies_are_cut(spark):
    row = [(1, "S", "p", "T", "x" * 6001, "en", "u", 1.23456, True)]
    df = spark.createDataFrame(row, "n int, source string, published string, title string, text string, lang string, url string, score double, partial boolean")
    text = report.corpus_text(df).first()["corpus"]
    assert "x" * 6000 + " …[truncated]\n" in text and "x" * 6001 not in text
    assert "Relevance: 1.235\nNote: lede only" in text
    facts = report.facts_of_text(report.corpus_text(df)).first()
    assert (facts["articles"], facts["outlets"]) == (1, "S (1)")


def test_custom_scorer(spark):
    df = spark.createDataFrame([("a", "b"), ("c", None)], "title string, text string")
    got = rank.scored(df, "q", lambda query, passages: [float(len(p)) for p in passages]).collect()
    assert [r["score"] for r in got] == [4.0, 0.0]


def test_plans_prune(spark, sf_dir):
    plan = table(spark, sf_dir, "documents").where("source = 'src1'").select("doc_id")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(source), EqualTo(source,src1)]" in plan and "ReadSchema: struct<doc_id:bigint,source:string>" in plan
