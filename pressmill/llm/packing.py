"""Variable-capacity best-fit packing of documents into training sequences.

Best-fit decreasing needs no more than how many pieces have each length, so it runs on that
histogram: its size is bounded by the largest capacity, whatever the number of documents, and
bins with the same free space are runs of consecutive bin numbers. Placing the pieces of one
length moves whole runs, which gives exactly what placing them one by one would.

The permitted capacities are optimised jointly. A new bin opens at the least-cost capacity that
takes its first piece and is not below a floor; a best fit is made for each permitted
capacity as the floor; at the end every bin shrinks to the least-cost capacity that holds its
contents. The plan of least total cost wins. The plan's rows are spans of pieces of one length,
ranked; documents find their bins by their piece's length and rank.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pressmill.llm.common import materialize, offsets, table
from pressmill.llm.tokens import token_lengths

CAPACITIES = (1024, 2048, 4096, 8192)
#: A sequence of c tokens costs c, c * c / ATTENTION for attention, and BIN_COST for itself.
BIN_COST = 64
ATTENTION = 65536


@dataclass
class Plan:
    """Spans: pieces of a length from rank ``lo`` on go to bins from ``bin`` on, ``each`` to a bin."""

    cost: float = 0
    bins: int = 0
    spans: list[tuple[int, int, int, int, int, int]] = field(default_factory=list)  # length, lo, n, bin, each, offset
    runs: list[tuple[int, int, int]] = field(default_factory=list)  # first bin, bins, capacity after shrinking


def sequence_cost(capacity: int) -> float:
    return capacity + capacity * capacity / ATTENTION + BIN_COST


def least_cost(capacities: tuple[int, ...], used: int, cost: Callable[[int], float] = sequence_cost) -> int:
    """The cheapest permitted capacity that holds ``used`` tokens."""
    return min((c for c in capacities if c >= used), key=lambda c: (cost(c), c))


def best_fit(
    histogram: dict[int, int], capacities: tuple[int, ...], floor: int, cost: Callable[[int], float] = sequence_cost
) -> Plan:
    """Best-fit decreasing over counts of lengths, bins opened at ``floor`` or above."""
    plan = Plan()
    free: dict[int, list[tuple[int, int, int]]] = {}  # free space -> runs of (first bin, bins, capacity)
    spaces: list[int] = []

    def give(space: int, run: tuple[int, int, int]) -> None:
        if run[1]:
            if space not in free:
                free[space] = []
                insort(spaces, space)
            free[space].append(run)

    def fill(length: int, lo: int, n: int, space: int, run: tuple[int, int, int]) -> int:
        """Puts up to n pieces into the run; returns how many."""
        first, bins, capacity = run
        each = space // length
        full = min(bins, n // each)
        if full:
            plan.spans.append((length, lo, full * each, first, each, capacity - space))
            give(space - each * length, (first, full, capacity))
        rest = n - full * each if full < bins else 0
        rest = min(rest, each - 1)
        if rest:
            plan.spans.append((length, lo + full * each, rest, first + full, rest, capacity - space))
            give(space - rest * length, (first + full, 1, capacity))
        give(space, (first + full + bool(rest), bins - full - bool(rest), capacity))
        return full * each + rest

    for length in sorted(histogram, reverse=True):
        lo, n = 0, histogram[length]
        while n:
            at = bisect_left(spaces, length)
            if at < len(spaces):
                space = spaces[at]
                run = free[space].pop()
                if not free[space]:
                    del free[space]
                    spaces.pop(at)
            else:
                space = least_cost(tuple(c for c in capacities if c >= floor), max(length, floor), cost)
                bins = -(-n // (space // length))
                run = (plan.bins, bins, space)
                plan.bins += bins
            done = fill(length, lo, n, space, run)
            lo, n = lo + done, n - done
    for space, runs in free.items():
        for first, bins, capacity in runs:
            shrunk = least_cost(capacities, capacity - space, cost)
            plan.runs.append((first, bins, shrunk))
            plan.cost += bins * cost(shrunk)
    plan.runs.sort()
    return plan


def joint_plan(
    histogram: dict[int, int], capacities: tuple[int, ...], cost: Callable[[int], float] = sequence_cost
) -> Plan:
    """The cheapest of the best fits that open bins at each permitted capacity or above."""
    return min((best_fit(histogram, capacities, c, cost) for c in sorted(capacities)), key=lambda p: p.cost)


def _pieces(largest: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Cuts rows ``(id, n)`` and numbers the pieces of each length within the task, so that no length is numbered in one place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        cell, so_far = TaskContext.get().partitionId(), np.zeros(largest + 1, np.int64)
        for b in batches:
            n = b.column("n").to_numpy()
            parts = -(-n // largest)
            row = np.repeat(np.arange(len(n)), parts)
            piece = np.arange(len(row)) - np.repeat(np.cumsum(parts) - parts, parts)
            size = np.minimum(n[row] - piece * largest, largest)
            order = np.argsort(size, kind="stable")
            kinds, begin, count = np.unique(size[order], return_index=True, return_counts=True)
            nth = np.empty(len(size), np.int64)
            nth[order] = np.arange(len(size)) - np.repeat(begin, count) + np.repeat(so_far[kinds], count)
            so_far[kinds] += count
            yield pa.RecordBatch.from_arrays(
                [b.column("id").take(pa.array(row)), pa.array(piece.astype(np.int32)), pa.array(size.astype(np.int32)), pa.array(np.full(len(row), cell, np.int32)), pa.array(nth)],
                ["id", "piece", "len", "cell", "nth"],
            )

    return run


def pack(
    lengths: DataFrame, capacities: tuple[int, ...] = CAPACITIES, id_col: str = "id", n_col: str = "n",
    cost: Callable[[int], float] = sequence_cost,
) -> DataFrame:
    """``(id, piece, tokens, bin, offset, capacity)``: where every piece of every document goes.

    A document longer than the largest capacity is cut into full pieces and a rest; nothing is
    dropped. A null length counts as zero, a document of length zero is packed as one
    piece of one (padding) token. Pieces of one length are ranked as their tasks write them; repeated rows are
    packed once each; a null id is one like any other. Other columns are ignored. An empty table gives an empty result.
    """
    largest = max(capacities)
    rows = lengths.select(
        F.col(id_col).cast("long").alias("id"), F.greatest(F.coalesce(F.col(n_col).cast("long"), F.lit(0)), F.lit(1)).alias("n")
    )
    rows = materialize(rows.mapInArrow(_pieces(largest), "id long, piece int, len int, cell int, nth long"), "pieces")

    # a row for each length and task that wrote some; then one for each length: at most `largest`
    cells = materialize(rows.groupBy("len", "cell").agg(F.count("*").alias("c")), "cells")
    sizes = cells.groupBy("len").agg(F.sum("c").alias("n"))
    plan = joint_plan({r["len"]: r["n"] for r in sizes.collect()}, capacities, cost)

    # ranks of the pieces of a length: those of the tasks before, and the place in the own one
    first = offsets(cells, ["cell"], "c", "first", ["len"])
    rows = rows.join(first.select("len", "cell", "first"), ["len", "cell"])
    rows = rows.select("id", "piece", "len", (F.col("first") + F.col("nth")).alias("rank"))

    # the plan is bounded by the lengths that occur, not by the documents
    spans = np.array(sorted(plan.spans), np.int64).reshape(-1, 6)
    runs = np.array(plan.runs, np.int64).reshape(-1, 3)
    sent = lengths.sparkSession.sparkContext.broadcast((spans, runs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spans, runs = sent.value
        # by (length, rank): a length's spans are consecutive and begin at rank 0
        begins = {int(x): int(i) for x, i in zip(*np.unique(spans[:, 0], return_index=True), strict=True)}
        for b in batches:
            own, rank = b.column("len").to_numpy(), b.column("rank").to_numpy()
            at = np.empty(len(own), np.int64)
            for length in np.unique(own):
                mine = own == length
                lo = begins[int(length)]
                hi = bisect_right(spans[:, 0], length)
                at[mine] = lo + np.searchsorted(spans[lo:hi, 1], rank[mine], "right") - 1
            s, within = spans[at], rank - spans[at, 1]
            bin_, nth = s[:, 3] + within // s[:, 4], within % s[:, 4]
            capacity = runs[np.searchsorted(runs[:, 0], bin_, "right") - 1, 2]
            yield pa.RecordBatch.from_arrays(
                [b.column("id"), b.column("piece"), pa.array(own.astype(np.int64)), pa.array(bin_), pa.array(s[:, 5] + nth * own), pa.array(capacity)],
                ["id", "piece", "tokens", "bin", "offset", "capacity"],
            )

    return rows.mapInArrow(run, "id long, piece int, tokens long, bin long, offset long, capacity long")


def document_lengths(docs: DataFrame) -> DataFrame:
    """Token counts of documents with one end token each."""
    return token_lengths(docs).withColumn("n", F.col("n") + 1)


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(document_lengths(table(spark, sf_dir, "documents"))).withColumnRenamed("id", "doc_id")
