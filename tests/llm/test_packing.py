import random
from collections import Counter, defaultdict

import pytest

from pressmill.llm import packing


def one_by_one(lengths, capacities, floor, cost):
    """Best-fit decreasing, a piece at a time."""
    bins = []
    for n in sorted(lengths, reverse=True):
        fits = [b for b in bins if b[0] >= n]
        if fits:
            b = min(fits, key=lambda b: b[0])
        else:
            c = min((c for c in capacities if c >= max(n, floor)), key=cost)
            bins.append(b := [c, c])
        b[0] -= n
    return sorted(min((c for c in capacities if c >= used), key=cost) for used in (b[1] - b[0] for b in bins))


@pytest.mark.parametrize("seed", range(8))
def test_counts_pack_like_single_pieces(seed):
    rng = random.Random(seed)
    capacities = (16, 64, 100)
    lengths = [rng.randrange(1, 101) if rng.random() < 0.3 else rng.randrange(1, 12) for _ in range(rng.randrange(1, 400))]
    cost = lambda c: c + 3
    for floor in capacities:
        plan = packing.best_fit(Counter(lengths), capacities, floor, cost)
        assert sorted(c for _, n, c in plan.runs for _ in range(n)) == one_by_one(lengths, capacities, floor, cost)
        assert sum(n for _, _, n, _, _, _ in plan.spans) == len(lengths)
    best = packing.joint_plan(Counter(lengths), capacities, cost)
    assert best.cost == min(packing.best_fit(Counter(lengths), capacities, c, cost).cost for c in capacities)


def check(spark, rows, capacities):
    got = packing.pack(spark.createDataFrame(rows, "id long, n long, piece int"), capacities).collect()
    assert len(got) == sum(max(1, -(-(n or 1) // capacities[-1])) for _, n, _ in rows)
    total = defaultdict(int)
    for r in got:
        total[r["id"]] += r["tokens"]
    want = defaultdict(int)
    for i, n, _ in rows:
        want[i] += max(1, n or 1)
    assert total == want
    bins = defaultdict(list)
    for r in got:
        assert r["capacity"] in capacities
        bins[r["bin"], r["capacity"]].append((r["offset"], r["tokens"]))
    assert len({b for b, _ in bins}) == len(bins)
    for (_, capacity), pieces in bins.items():
        at = 0
        for offset, n in sorted(pieces):
            assert offset == at
            at += n
        assert at <= capacity and packing.least_cost(capacities, at) == capacity


def test_pieces_fill_their_bins(spark):
    rng = random.Random(10)
    rows = [(k, rng.choice([None, 0, 1, 3, 3, 3, 20, 64, 65, 500, rng.randrange(1, 130)]), 5) for k in range(400)]
    check(spark, [*rows, rows[5], (None, 9, 5)], (8, 32, 64))
    check(spark, [(None if k % 3 else 7, 5, 0) for k in range(90)] + [(1, 1_000_000, 0)], (8, 32, 64))  # hot length, hot and null ids


def test_empty_table(spark):
    assert packing.pack(spark.createDataFrame([], "id long, n long")).collect() == []
