import random
import subprocess
import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline as pipeline
from pressmill.llm import copies, langid, packing, quality, simhash
from pressmill.operators import dedupe
from tests.llm.util import documents, odd_texts, words


def test_stages_filter_and_pack(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = {r["doc_id"] for r in docs.select("doc_id").collect()}
    columns, texts = docs.columns, {r["doc_id"]: r["text"] for r in docs.collect()}
    for name, stage in pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf_dir).cache()
        now = {r["doc_id"] for r in docs.select("doc_id").collect()}
        assert docs.columns == columns and now < before or now == before, name
        assert docs.count() == len(now)
        before = now
    assert len(set(texts[i] for i in before)) == len(before)  # no exact copies
    packed = pipeline.STAGES[-1][1](spark, docs, sf_dir).collect()
    assert {r["doc_id"] for r in packed} == before


def test_run_is_registered(spark, sf_dir):
    assert [n for n, _ in pipeline.STAGES] == ["language_id", "quality_filter", "near_dedup", "decontamination", "packing"]
    out = entry.queries()["pipeline"](spark, sf_dir)
    assert out.columns == ["doc_id", "piece", "tokens", "bin", "offset", "capacity"] and out.count() > 50


def test_benchmark_items_go(spark, sf_dir):
    item = spark.read.parquet(f"{sf_dir}/benchmark.parquet").orderBy("item_id").first()["text"]
    rows = [(1, f"Begin here. {item} And end.", "en", "s", 9), (2, "nothing of it", "en", "s", 9), (None, None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    left = pipeline.decontamination(spark, docs, sf_dir)
    assert sorted((r["doc_id"] or 0) for r in left.collect()) == [0, 2]


def test_all_operators_registered():
    names = entry.queries()
    assert all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11))


def test_stages_take_odd_rows_and_none(spark, sf_dir):
    rng = random.Random(18)
    texts = [*odd_texts(rng), *(" ".join(words(rng, 40)) for _ in range(30))]
    rows = [(5000 + k, t, None if k % 5 == 0 else "en", None if k % 7 == 0 else "src1") for k, t in enumerate(texts)]
    rows += [rows[-1], (None, texts[-1], "en", "src1"), (None, None, None, None)]
    for docs in (documents(spark, rows), documents(spark, [])):
        columns = docs.columns
        for name, stage in pipeline.STAGES:
            out = stage(spark, docs, sf_dir).cache()
            assert out.count() <= 2 * len(rows)
            if name != "packing":
                assert out.columns == columns, name
                docs = out
        if docs.count():
            kept = {r["doc_id"] for r in docs.collect()}
            assert None in kept and {r["doc_id"] for r in out.collect()} == kept
            assert {5000 + k for k in range(len(texts) - 25, len(texts))} <= kept  # clean documents stay


def test_beyond_the_broadcast_bound(spark, sf_dir, monkeypatch):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    few = {r["doc_id"] for r in pipeline.near_dedup(spark, docs, sf_dir).collect()}
    monkeypatch.setattr(pipeline, "BROADCAST_IDS", 0)
    assert {r["doc_id"] for r in pipeline.near_dedup(spark, docs, sf_dir).collect()} == few


def test_near_copies_go(spark, sf_dir):
    rng = random.Random(21)
    rows, expected = [], set()
    for k in range(30):
        text = words(rng, 120, 5000)
        again = list(text)
        again[10 + k] = "altered"  # 111 of 121 five-word shingles: about 0.92, several bits apart
        other = [w if j % 5 else f"other{j}" for j, w in enumerate(text)]  # no shingle in common
        rows += [(100 * k + 1, " ".join(text)), (100 * k + 2, " ".join(again)), (100 * k + 3, " ".join(other))]
        expected |= {100 * k + 1, 100 * k + 3}
    # a chain: the last is like the one that goes, not like the first, and stays
    chain = words(rng, 200, 5000)
    second = ["x" if j in (20, 60, 100) else w for j, w in enumerate(chain)]
    third = ["y" if j in (40, 80, 120) else w for j, w in enumerate(second)]
    rows += [(9001, " ".join(chain)), (9002, " ".join(second)), (9003, " ".join(third)), (9004, "?!"), (9005, " ?!\n"), (9006, "!?")]
    docs = documents(spark, rows)
    kept = {r["doc_id"] for r in pipeline.near_dedup(spark, docs, sf_dir).collect()}
    assert kept == expected | {9001, 9003, 9004, 9006}


def test_rows_of_files_are_numbered_by_their_place(spark, sf_dir, tmp_path, monkeypatch):
    rng = random.Random(22)
    rows = [(k, " ".join(words(rng, 30))) for k in range(40)]
    rows += [rows[3], rows[3], (None, rows[5][1]), (None, rows[6][1]), (None, None), (7, rows[8][1])]
    path = f"{tmp_path}/some files"
    documents(spark, rows).withColumn("_metadata", F.lit("x")).repartition(3).write.parquet(path)
    docs = spark.read.parquet(path)
    numbered = pipeline._numbered(docs)
    assert numbered.columns == [*docs.columns, pipeline.ROW]
    first = {r[pipeline.ROW]: (r["doc_id"], r["text"]) for r in numbered.collect()}
    assert len(first) == len(rows)
    assert first == {r[pipeline.ROW]: (r["doc_id"], r["text"]) for r in numbered.repartition(7).select("text", "doc_id", pipeline.ROW).collect()}
    kept = sorted(map(str, (r["doc_id"] for r in pipeline.near_dedup(spark, docs, sf_dir).collect())))
    # the null text stays; of the text of 8 the row that comes first by id is the second one with id 7
    assert kept == sorted(map(str, [*range(8), 7, *range(9, 40), None]))
    monkeypatch.setattr(pipeline, "BROADCAST_FILES", 0)
    assert kept == sorted(map(str, (r["doc_id"] for r in pipeline.near_dedup(spark, docs, sf_dir).collect())))


def test_near_copies_meet_by_their_fingerprints(spark, sf_dir, monkeypatch):
    """Pairs that share lists of positional bytes come by these alone, all others by shingles."""
    rng = random.Random(23)
    rows, close, far = [], set(), set()
    for k in range(40):
        text = words(rng, 150, 5000)
        again = list(text)
        for at in rng.sample(range(10, 140), 1 + k % 2):
            again[at] = "altered"
        u, v = (simhash.fingerprint(" ".join(w).encode(), 5) for w in (text, again))
        (close if any(not (u ^ v) & m for m in simhash.WIDE_LISTS) else far).add(100 * k + 2)
        rows += [(100 * k + 1, " ".join(text)), (100 * k + 2, " ".join(again))]
    docs, first = documents(spark, rows), {i for i, _ in rows if i % 100 == 1}
    assert len(close) >= 5 and len(far) >= 1
    kept = lambda: {r["doc_id"] for r in pipeline.near_dedup(spark, docs, sf_dir).collect()}
    assert kept() == first
    monkeypatch.setattr(simhash, "wide_postings", lambda fps, f=simhash.wide_postings: f(fps).limit(0))
    assert kept() == first | close


def test_texts_stay_where_they_are_while_ids_are_few(spark, sf_dir, tmp_path, monkeypatch):
    """Whole texts were shuffled to pick those that post other shingles, and those that are compared."""
    rng = random.Random(24)
    rows = []
    for k in range(60):
        text = words(rng, 120, 5000)
        text[:8] = ["every", "text", "begins", "with", "the", "same", "eight", "words"]
        rows += [(10 * k, " ".join(text)), (10 * k + 1, " ".join([*text[:-1], "end"]))]
    plans = []
    for module, name in ((copies, "materialize"), (dedupe, "written")):
        write = lambda df, label, f=getattr(module, name): plans.append(df._jdf.queryExecution().executedPlan().toString()) or f(df, label)
        monkeypatch.setattr(module, name, write)
    monkeypatch.setattr(copies, "COMMON", 4)
    documents(spark, rows).write.parquet(f"{tmp_path}/docs")
    docs = spark.read.parquet(f"{tmp_path}/docs")

    def moved():
        plans.clear()
        kept = {r["doc_id"] for r in pipeline.near_dedup(spark, docs, sf_dir).collect()}
        lines = [p.splitlines() for p in plans]
        return kept, sum(" Exchange " in a and "text#" in b for p in lines for a, b in zip(p, p[1:], strict=False))

    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert moved() == ({10 * k for k in range(60)}, 0)
        monkeypatch.setattr(copies, "BROADCAST_IDS", 0)
        kept, times = moved()
        assert kept == {10 * k for k in range(60)} and times >= 2
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_executors_hold_few_rows_and_few_workers(spark, sf_dir, monkeypatch):
    """Tasks sent 10,000 whole texts to Python at once, packing kept two workers for each task."""
    key, seen = "spark.sql.execution.arrow.maxRecordsPerBatch", []
    before = spark.conf.get(key)
    for module in (pipeline, copies, langid, packing, quality):
        write = lambda df, label, f=module.materialize: seen.append((label, int(spark.conf.get(key)), df._jdf.queryExecution().executedPlan().toString().count("MapInArrow"))) or f(df, label)
        monkeypatch.setattr(module, "materialize", write)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in pipeline.STAGES:
        stage(spark, docs, sf_dir)
        assert spark.conf.get(key) == before
    to_python = {label: (rows, maps) for label, rows, maps in seen if maps}
    assert {"langid", "languages", "features", "sure", "prefixes", "lengths", "pieces"} <= set(to_python)
    assert all(rows <= pipeline.BATCH_ROWS and maps == 1 for rows, maps in to_python.values())


def test_the_setting_of_batches_comes_back(spark, sf_dir, monkeypatch):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    docs = documents(spark, [(1, "some words", "en", "s")])
    monkeypatch.setattr(langid, "identify", lambda rows: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        pipeline.language_id(spark, docs, sf_dir)
    assert spark.conf.get(key) == before
    monkeypatch.setattr(langid, "identify", lambda rows: rows.select("id", F.lit(spark.conf.get(key) == "7").alias("accepted")))
    spark.conf.set(key, 7)  # smaller ones hold
    try:
        assert pipeline.language_id(spark, docs, sf_dir).count() == 1 and spark.conf.get(key) == "7"
    finally:
        spark.conf.set(key, before)


def test_workers_need_no_pandas():
    """Workers of near_dedup held it for the rest of their lives."""
    code = "import sys, corpus_pipeline; from pressmill.llm import copies, langid, packing, quality; print('pandas' in sys.modules)"
    root = Path(pipeline.__file__).parent
    said = subprocess.run([sys.executable, "-c", code], cwd=root, capture_output=True, text=True, timeout=120)
    assert said.stdout.strip() == "False", said.stderr
