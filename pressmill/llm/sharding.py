"""Minimax contiguous sharding of ordered atomic groups, in DataFrame operations only.

Rows with equal text form one atomic group. Groups are ordered by the 64-bit hash of the
text, and by length and CRC should two texts share one; their running sum of sizes gives
each group an *end*. A shard is a run of groups, so a sharding is a list of ends to cut at.

The smallest feasible capacity is found by binary search, each candidate checked greedily: from
the last cut go to the largest end within the capacity. The driver never holds all ends. It
starts with the first and last end of each of ``2**BUCKET_BITS`` hash ranges, runs the search
on those, and notes every lookup that fell into a gap with ends it does not know; one
aggregation then splits just these gaps further, until a whole search met no open gap. Its
result is exact, and what is collected is bounded by ``MAX_SUMMARY``, whatever the data.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pressmill.llm.common import materialize, offsets, table, text_or_empty

SHARDS = 40
ROW_OVERHEAD = 16
#: Hash ranges of the first summary.
BUCKET_BITS = 14
#: Rows that one refinement collects at most, up to one more for each gap.
MAX_SUMMARY = 40_000
#: Bits of a row's number that count within the task that wrote it.
TASK_BITS = 33


def sized_rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(id, size, crc, grp, tie, row)``: what sharding needs of a row, without its text; ``grp`` and ``tie`` name its group."""
    text = F.col(text_col).cast("string")
    return docs.select(
        F.col(id_col).cast("long").alias("id"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + ROW_OVERHEAD).cast("long").alias("size"),
        F.crc32(text_or_empty(F.col(text_col))).alias("crc"),
        F.xxhash64(text).alias("grp"),
        F.coalesce(F.shiftleft(F.octet_length(text).cast("long"), 32) + F.crc32(text), F.lit(-1)).alias("tie"),
        F.monotonically_increasing_id().alias("row"),
    )


def group_ends(rows: DataFrame) -> DataFrame:
    """``(grp, tie, bucket, end)``: the running sum of sizes over the groups in order of ``grp`` and ``tie``."""
    groups = rows.groupBy("grp", "tie").agg(F.sum("size").alias("size"))
    groups = groups.withColumn("bucket", F.shiftright("grp", 64 - BUCKET_BITS).cast("int"))
    before = offsets(groups.groupBy("bucket").agg(F.sum("size").alias("s")), ["bucket"], "s", "before")
    # before has at most 2**BUCKET_BITS rows
    groups = groups.join(F.broadcast(before.select("bucket", "before")), "bucket")
    run = Window.partitionBy("bucket").orderBy("grp", "tie").rowsBetween(Window.unboundedPreceding, 0)
    return groups.select("grp", "tie", "bucket", (F.col("before") + F.sum("size").over(run)).alias("end"))


class Ends:
    """Sorted ends as far as they are known; ``open`` counts unknown ones after each."""

    def __init__(self, spans: list[tuple[int, int, int, int]]):
        """spans: bucket, first end, last end and number of ends of each summary cell."""
        self.known, self.open, self.bucket, self.touched = [0], [0], [0], set()
        self._add(spans)

    def _add(self, spans: list[tuple[int, int, int, int]]) -> None:
        rows = list(zip(self.known, self.open, self.bucket, strict=True))
        for bucket, first, last, n in spans:
            rows.append((first, max(0, n - 2), bucket))
            if n > 1:
                rows.append((last, 0, bucket))
        rows.sort()
        self.known, self.open, self.bucket = (list(x) for x in zip(*rows, strict=True))

    def floor(self, at: int) -> int:
        """The largest known end at or below ``at``; exact if no gap is touched."""
        i = bisect_right(self.known, at) - 1
        if self.open[i] and at > self.known[i]:
            self.touched.add(i)
        return self.known[i]

    def ceil(self, at: int) -> int:
        """The smallest known end at or above ``at``; exact if no gap is touched."""
        i = bisect_left(self.known, at)
        if self.known[i] != at and self.open[i - 1]:
            self.touched.add(i - 1)
        return self.known[i]

    def refine(self, ends: DataFrame) -> None:
        """Learns more ends in the touched gaps, by one aggregation over these alone."""
        cells = max(2, MAX_SUMMARY // len(self.touched))
        gaps = ", ".join(f"({self.bucket[i]}, {self.known[i]}L, {self.known[i + 1]}L)" for i in sorted(self.touched))
        gaps = ends.sparkSession.sql(f"select * from values {gaps} as gaps(bucket, low, high)")
        # at most as many gaps as a search makes lookups
        inside = ends.join(F.broadcast(gaps), "bucket").where("low < end and end < high")
        cell = F.expr(f"(end - low - 1) div greatest(1, (high - low + {cells - 1}) div {cells})")
        found = inside.groupBy("bucket", "low", cell.alias("cell")).agg(F.min("end"), F.max("end"), F.count("*"))
        spans = [(r[0], *tuple(r)[3:]) for r in found.collect()]
        for i in self.touched:
            self.open[i] = 0
        self.touched = set()
        self._add(spans)


def _greedy(ends: Ends, total: int, capacity: int, shards: int) -> list[int]:
    """Cuts after each greedily filled shard; the last is ``total`` if the capacity is feasible."""
    at, cuts = 0, []
    for _ in range(shards):
        at = ends.floor(min(total, at + capacity))
        cuts.append(at)
        if at == total:
            break
    return cuts


def _search(ends: Ends, total: int, shards: int) -> tuple[int, list[int]]:
    """The least feasible capacity, and cuts that keep to it and are as even as it lets them be."""
    low, high = max(1, -(-total // shards)), total
    while low < high:
        mid = (low + high) // 2
        if _greedy(ends, total, mid, shards)[-1] == total:
            high = mid
        else:
            low = mid + 1
    # no cut may lie before what the shards after it can take
    least = [total]
    for _ in range(shards - 1):
        least.append(ends.ceil(max(0, least[-1] - low)))
    at, cuts = 0, []
    for k in range(shards):
        left = shards - k
        aim = at + -(-(total - at) // left)
        under, over = ends.floor(aim), ends.ceil(aim)
        cut = under if aim - under <= over - aim and under > at else over
        at = min(max(cut, least[left - 1]), ends.floor(min(total, at + low)))
        cuts.append(at)
    return low, cuts


def minimax_cuts(ends: DataFrame, shards: int) -> tuple[int, list[tuple[int, int]]]:
    """The least largest-shard size and the group (``grp``, ``tie``) after which each shard but the last ends."""
    spans = ends.groupBy("bucket").agg(F.min("end"), F.max("end"), F.count("*")).collect()
    if not spans:
        return 0, []
    known = Ends([tuple(r) for r in spans])
    total = known.known[-1]
    while True:
        capacity, cuts = _search(known, total, shards)
        if not known.touched:
            break
        known.refine(ends)
    at = {r["end"]: (r["grp"], r["tie"]) for r in ends.where(F.col("end").isin(sorted({*cuts} - {0}))).collect()}
    floor = (-(1 << 63), -(1 << 63))  # a shard that stays empty ends before every hash
    return capacity, [at.get(c, floor) for c in cuts[:-1]]


def shard_rows(docs: DataFrame, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, size, crc, grp, tie, shard, slot, capacity)``, one row per row of ``docs``.

    Shards are contiguous runs of the groups of equal texts, their largest size is the least
    possible, and within that they are as even as cuts from the left allow. Slots count from
    0 in each shard without gaps, in the order that the rows were read in. A null text has size 16, the CRC of the empty text and a
    group of its own kind; a null id keeps its place by the other columns. Repeated rows
    share a shard and get slots of their own. Extra columns are ignored; an empty table gives
    an empty result; a group larger than the mean makes a larger shard, as it is atomic.
    """
    rows = materialize(sized_rows(docs, id_col, text_col), "sized")
    ends = materialize(group_ends(rows), "ends")
    capacity, cuts = minimax_cuts(ends, shards)
    pair = lambda grp, tie: F.struct(grp.cast("long").alias("grp"), tie.cast("long").alias("tie"))
    marks = F.array(*[pair(F.lit(g), F.lit(t)) for g, t in cuts]) if cuts else F.array().cast("array<struct<grp: bigint, tie: bigint>>")
    rows = rows.withColumn("shard", F.size(F.filter(marks, lambda c: c < pair(F.col("grp"), F.col("tie")))).cast("int"))
    # numbered by the written row: a cell is what one task wrote, so neither a hot text nor a hot id fills one
    rows = rows.withColumn("cell", F.shiftright("row", TASK_BITS).cast("int"))
    first = offsets(rows.groupBy("shard", "cell").agg(F.count("*").alias("n")), ["cell"], "n", "first", ["shard"])
    inner = F.row_number().over(Window.partitionBy("shard", "cell").orderBy("row"))
    rows = rows.withColumn("inner", inner).join(first.select("shard", "cell", "first"), ["shard", "cell"])
    slot = (F.col("first") + F.col("inner") - 1).alias("slot")
    return rows.select("id", "size", "crc", "grp", "tie", "shard", slot, F.lit(capacity).cast("long").alias("capacity"))


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = shard_rows(table(spark, sf_dir, "documents"))
    return out.select(
        F.col("id").alias("doc_id"),
        "size",
        F.col("crc").alias("text_crc32"),
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
        "capacity",
    )
