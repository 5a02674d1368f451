import random

import xxhash

from pressmill.llm import simhash
from pressmill.llm.components import connected_components
from tests.llm.util import documents, odd_texts, words


def slow_fingerprint(text):
    w = [x for x in "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").translate({c: 32 for c in range(9, 14)}).split(" ") if x]
    grams = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_components(rows):
    fps = [(i, slow_fingerprint(t)) for i, t in rows]
    root = list(range(len(fps)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(fps)):
        for b in range(a):
            if (fps[a][1] ^ fps[b][1]).bit_count() <= 2:
                root[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(fps):
        least[find(k)] = min(least.get(find(k), i), i)
    return sorted((i, fp, least[find(k)]) for k, (i, fp) in enumerate(fps))


def sample(seed=1):
    rng = random.Random(seed)
    rows = [(k, t) for k, t in enumerate(odd_texts(rng))]
    base = words(rng, 300)
    for k in range(100, 180):
        w = list(base)
        for _ in range(k % 4):
            w[rng.randrange(len(w))] = "changed"
        rows.append((k, " ".join(w) if k % 2 else "\n".join(w).upper()))
    rows += [(k, " ".join(words(rng, rng.randrange(1, 80)))) for k in range(200, 260)]
    return [*rows, rows[8], rows[0]]


def compare(spark, rows):
    got = simhash.near_duplicates(documents(spark, rows)).collect()
    assert sorted((r["id"], r["fp"] % (1 << 64), r["component"]) for r in got) == slow_components(rows)


def test_against_brute_force(spark):
    compare(spark, sample())


def test_long_postings_take_the_other_way(spark, monkeypatch):
    monkeypatch.setattr(simhash, "POSTING_PAIRS", 1)
    compare(spark, sample(2))


def test_empty_table_and_null_ids(spark):
    assert simhash.near_duplicates(documents(spark, [])).collect() == []
    got = simhash.near_duplicates(documents(spark, [(None, "a b c d"), (5, "a b c d"), (None, "other words here")])).collect()
    assert sorted((r["id"] or 0, r["component"] or 0) for r in got) == [(0, 0), (0, 5), (5, 5)]


def test_components_of_a_long_path(spark):
    edges = [(k, k + 1) for k in range(40)] + [(100, 101), (102, 101), (7, 7), (None, 3)]
    got = {r["node"]: r["root"] for r in connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**{k: 0 for k in range(41)}, 100: 100, 101: 100, 102: 100}
    assert connected_components(spark.createDataFrame([], "u long, v long")).collect() == []
