import random
import zlib
from collections import defaultdict

import pytest

from pressmill.llm import sharding
from tests.llm.util import documents, odd_texts, words


def least_capacity(sizes, shards):
    """By trying every capacity from the least sensible one."""
    capacity = max(max(sizes), -(-sum(sizes) // shards))
    while True:
        used, room = 1, capacity
        for s in sizes:
            if s > room:
                used, room = used + 1, capacity
            room -= s
        if used <= shards:
            return capacity
        capacity += 1


def check(spark, rows, shards):
    got = sharding.shard_rows(documents(spark, rows), shards).collect()
    assert len(got) == len(rows)
    groups, where, slots = defaultdict(int), defaultdict(set), defaultdict(list)
    for r in got:
        groups[r["grp"], r["tie"]] += r["size"]
        where[r["grp"], r["tie"]].add(r["shard"])
        slots[r["shard"]].append(r["slot"])
    assert all(len(s) == 1 for s in where.values())
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    order = [min(where[g]) for g in sorted(groups)]
    assert order == sorted(order) and 0 <= order[0] and order[-1] < shards
    loads = defaultdict(int)
    for r in got:
        loads[r["shard"]] += r["size"]
    want = least_capacity([groups[g] for g in sorted(groups)], shards)
    assert got[0]["capacity"] == want == max(loads.values())
    texts = sorted((i or 0, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t in rows)
    assert sorted((r["id"] or 0, r["size"], r["crc"]) for r in got) == texts


@pytest.mark.parametrize("bits,summary", [(14, 40_000), (2, 8)])
def test_against_brute_force(spark, monkeypatch, bits, summary):
    monkeypatch.setattr(sharding, "BUCKET_BITS", bits)
    monkeypatch.setattr(sharding, "MAX_SUMMARY", summary)
    rng = random.Random(3)
    rows = [(k, " ".join(words(rng, rng.randrange(1, 60)))) for k in range(300)]
    check(spark, rows, 12)


def test_hot_text_and_odd_rows(spark):
    rng = random.Random(4)
    rows = [(k, "the same text again") for k in range(200)] + [(200 + k, t) for k, t in enumerate(odd_texts(rng))]
    check(spark, [*rows, rows[0], (None, "no id")], 40)


def test_few_rows_and_none(spark):
    check(spark, [(1, "a"), (2, None)], 5)
    assert sharding.shard_rows(documents(spark, [])).collect() == []
