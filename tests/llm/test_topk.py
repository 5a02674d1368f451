import random
import time
from collections import Counter

import duckdb
import numpy as np
import pytest

from pressmill.llm import topk


def brute(rows, queries, k):
    """Every row of a query id asks, every row with another id is a candidate."""
    scores = {}
    for qi, q in queries:
        own = [(-int(np.dot(q, x[: len(q)] if len(x) >= len(q) else x + [0] * (len(q) - len(x)))), i) for i, x in rows if i != qi]
        scores.setdefault(qi, []).extend(own)
    return sorted((qi, r + 1, i, -s) for qi, own in scores.items() for r, (s, i) in enumerate(sorted(own)[:k]))


@pytest.mark.parametrize("scale", [1.0, 1e5, 1e13])
def test_against_brute_force(spark, scale):
    rng = random.Random(11)
    vectors = [(k, [rng.gauss(0, scale) for _ in range(16)], 1) for k in range(300)]
    vectors += [(400 + k, [0.5] * 16, 1) for k in range(60)]  # ties
    bad = [(900, None, 1), (901, [None] * 16, 1), (902, [float("nan")] * 16, 1), (903, [float("inf")] * 16, 1), (None, [1.0] * 16, 1)]
    frame = spark.createDataFrame([*vectors, vectors[0], *bad], "vec_id long, embedding array<double>, id int")
    rows = topk.quantised(frame, "vec_id", "embedding")
    want = [(k, [int(np.floor(64 * x)) for x in v]) for k, v, _ in [*vectors, vectors[0]]]
    assert sorted((r["id"], r["x"]) for r in rows.collect()) == sorted(want)
    got = topk.top_k(rows, rows.where("id % 20 = 0"), k=20, block_rows=100).collect()
    assert sorted(tuple(r) for r in got) == brute(want, [(k, v) for k, v in want if k % 20 == 0], 20)


def test_fewer_rows_than_k_and_none(spark):
    rows = spark.createDataFrame([(0, [1, 2]), (20, [3]), (5, [])], "id long, x array<long>")
    got = topk.top_k(rows, rows.where("id % 20 = 0"), k=20).collect()
    assert sorted(tuple(r) for r in got) == [(0, 1, 20, 3), (0, 2, 5, 0), (20, 1, 0, 3), (20, 2, 5, 0)]
    assert topk.top_k(rows.limit(0), rows.limit(0)).collect() == []


def test_repeated_ids_against_sql(spark, tmp_path):
    """Different vectors under one id are all candidates and all ask, as the SQL says."""
    rng = random.Random(3)
    rows = [(k % 90, [rng.gauss(0, 1) for _ in range(8)]) for k in range(200)] + [(1, [9.0] * 8), (1, [3.0] * 8)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    frame.write.parquet(f"{tmp_path}/embeddings.parquet")
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from read_parquet('{tmp_path}/embeddings.parquet/*.parquet')")
    want = sorted(con.execute(topk.ORACLE_SQL).fetchall())
    got = sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in topk.op4_topk(spark, str(tmp_path)).collect())
    assert got == want and max(Counter((q, v) for q, _, v, _ in got).values()) >= 2


def test_stops_before_all_segments():
    rng = np.random.default_rng(12)
    x = rng.normal(0, 8, (3000, 64)).astype(np.int64)
    x[:30] = x[0] + rng.normal(0, 1, (30, 64)).astype(np.int64)  # near rows are told from the others early
    index = topk.ImpactIndex(np.arange(3000), x)
    assert [low for low, *_ in index.segments][-1] == 1
    postings = sum(len(rows) for _, lists, _ in index.segments for _, rows, _ in lists)
    assert postings == np.count_nonzero(x)
    query, row, score, seen = index.search(np.arange(5), x[:5], 10)
    exact = x[:5] @ x.T
    for i in range(5):
        order = sorted((-exact[i, j], j) for j in range(3000) if j != i)[:10]
        assert [(-s, r) for s, r in zip(score[query == i], row[query == i], strict=True)] == order
    assert (seen < postings).all()
    # a threshold from elsewhere ends it sooner, and loses nothing at or above it
    least = score[query == 0].min()
    again = index.search(np.arange(1), x[:1], 10, np.array([least]))
    assert again[2].tolist() == score[query == 0].tolist() and again[3][0] <= seen[0]
    assert index.search(np.arange(1), x[:1], 10, np.array([1e6]))[3][0] < seen[0]


def test_blocks_that_cannot_reach_a_threshold_are_not_visited(spark, monkeypatch):
    rng = np.random.default_rng(5)
    centres = rng.normal(0, 60, (6, 16))
    rows = [(k, (centres[k % 6] + rng.normal(0, 1, 16)).astype(int).tolist()) for k in range(600)]
    frame = spark.createDataFrame(rows, "id long, x array<long>")
    counted = []
    visits = topk._visits
    monkeypatch.setattr(topk, "_visits", lambda *a: counted.append(visits(*a).cache()) or counted[-1])
    got = topk.top_k(frame, frame.where("id % 20 = 0"), k=5, block_rows=50).collect()
    assert sorted(tuple(r) for r in got) == brute(rows, [(k, v) for k, v in rows if k % 20 == 0], 5)
    blocks = topk._blocks(frame, 16, 600, 50).select("block").distinct().count()
    assert counted[0].count() == 30 and counted[1].count() < 0.7 * 30 * (blocks - 1)


def test_a_block_costs_little_more_than_a_plain_product():
    """Scattered additions, a posting list at a time, took over fifty times as long on full vectors."""
    rng = np.random.default_rng(13)
    x, q = (np.floor(64 * v / np.linalg.norm(v, axis=1)[:, None]).astype(np.int64) for v in (rng.normal(size=(8192, 64)), rng.normal(size=(128, 64))))
    index, bar = topk.ImpactIndex(np.arange(8192), x), np.full(128, 1500)
    a, b = q.astype(np.float64), x.T.astype(np.float64)

    def least(f):
        took = []
        for _ in range(3):
            began = time.process_time()
            f()
            took.append(time.process_time() - began)
        return min(took)

    plain = least(lambda: np.partition(a @ b, 8172, axis=1))
    assert least(lambda: index.search(np.arange(10_000, 10_128), q, 20, bar)) < 10 * plain
    assert least(lambda: index.search(np.arange(10_000, 10_128), q, 20)) < 10 * plain


@pytest.mark.parametrize("largest", [3, 40, 5000, 1 << 40])
def test_full_and_single_lists_against_brute_force(largest):
    rng = np.random.default_rng(14)
    x = np.rint(rng.normal(0, largest / 3, (700, 90))).astype(np.int64)
    x[:, 30:] *= rng.random((700, 60)) < 0.004  # lists of few rows
    x[100:180] = x[100]  # ties
    x[:20] = 0
    ids = np.sort(rng.integers(0, 500, 700))
    index, q, of = topk.ImpactIndex(ids, x), x[::7], ids[::7]
    exact = q @ x.T
    for k in (5, 20, 900):
        query, row, score, _ = index.search(of, q, k)
        bars = np.where(np.arange(len(q)) % 2, -np.inf, np.sort(exact, axis=1)[:, -12])
        some = index.search(of, q, k, bars)
        for i in range(len(q)):
            want = sorted((-int(exact[i, j]), int(ids[j])) for j in range(700) if ids[j] != of[i])[:k]
            assert [(-int(s), int(ids[r])) for s, r in zip(score[query == i], row[query == i], strict=True)] == want
            got = [(-int(s), int(ids[r])) for s, r in zip(some[2][some[0] == i], some[1][some[0] == i], strict=True)]
            assert got == want[: len(got)] and len(got) >= sum(-w[0] >= bars[i] for w in want)
