import json

from pressmill.__main__ import main


def test_harvest_search_corpus(spark, sf_dir, tmp_path):
    from pyspark.sql import functions as F

    from pressmill.sources.tables import articles

    rows = articles(spark, sf_dir).select(
        "url", "source", F.col("lang").alias("language"), "title", F.col("published").cast("string").alias("published"), "text",
        F.lit(1).cast("long").alias("words"), F.lit("").alias("fetched"), F.col("published").cast("date").alias("day"),
    )
    new, store, out = (str(tmp_path / x) for x in ("new", "store", "out"))
    rows.write.parquet(new)
    assert main(["harvest", "--archive", store, "--found", new, "--sources", "SRC1"], spark) == 1  # 20 articles at least
    assert main(["harvest", "--archive", store, "--found", new], spark) == 0
    assert main(["harvest", "--archive", store, "--found", new, "--sources", "nobody"], spark) == 2
    window = ["--archive", store, "--first", "2024-01-01", "--last", "2024-01-31", "--terms", "thing, ering"]
    assert main(["search", *window, "--out", out], spark) == 0
    found = spark.read.json(out).count()
    assert 0 < found < rows.count()
    assert main(["corpus", *window, "--subject", "thing", "--min-relevance", "0.0", "--out", out], spark) == 0
    assert 0 < spark.read.json(f"{out}/articles").count() <= found


def test_import_profiles(spark, tmp_path):
    file, store = tmp_path / "p.json", str(tmp_path / "profiles")
    file.write_text(json.dumps([{"name": "One", "terms": ["a"], "subject": "s"}, {"name": "Two", "terms": [" b "]}]))
    assert main(["import-profiles", "--profiles", store, "--file", str(file), "--dry-run"], spark) == 0 and not (tmp_path / "profiles").exists()
    assert main(["import-profiles", "--profiles", store, "--file", str(file)], spark) == 0
    assert sorted(r["id"] for r in spark.read.json(store).collect()) == ["one", "two"]
    file.write_text(json.dumps([{"name": "", "terms": ["a"]}]))
    assert main(["import-profiles", "--profiles", store, "--file", str(file)], spark) == 2
