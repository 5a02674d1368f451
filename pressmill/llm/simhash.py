"""SimHash near-duplicates by a byte-position inverted index with count filtering.

Two 64-bit fingerprints that differ in at most ``d = 2`` bits differ in at most two of
their eight bytes, so they share at least six positional bytes. Posting lists of single positional
bytes have only 256 values each and would meet every document with one in 256, so the index has two
levels: the positions form four blocks of two, and two differing bytes leave two whole blocks equal.
Within the fingerprints that agree in two blocks (four bytes, six such pairs of blocks) the other four
positional bytes are posted one by one. The index counts for each pair how many of these lists it meets
in: four bytes and two lists or more make the guaranteed six, pairs with fewer go, and the bit
distance verifies the rest.

Copies collapse before the index (one posting per distinct fingerprint). A posting list longer
than ``POSTING_PAIRS`` is not paired up, as its pairs would grow with its square: its members post
the 65 words within one bit of their fingerprint. Two fingerprints share such a word exactly if they differ
in two bits or fewer, at most 65 fingerprints can share one, and all of them are linked to the least
one, so the components are the same and neither rows nor groups grow with the square of a group.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pressmill.llm.common import materialize, table
from pressmill.llm.components import connected_components

SHINGLE_WORDS = 3
SEED = 42
MAX_BITS = 2
POSTING_PAIRS = 64
BYTES = 8
#: Pairs of blocks of two bytes, and with each the other four bytes one at a time: the keys of the index.
MASKS = [sum(0xFFFF << (16 * b) for b in pair) for pair in itertools.combinations(range(4), 2)]
LISTS = [m | 0xFF << (8 * p) for m in MASKS for p in range(BYTES) if not m >> (8 * p) & 0xFF]
LISTS_A_MASK = len(LISTS) // len(MASKS)
#: Lists of an index for similarities out of ``MAX_BITS``' reach: one block of two bytes and another byte.
WIDE_LISTS = [0xFFFF << (16 * b) | 0xFF << (8 * p) for b in range(4) for p in range(BYTES) if p // 2 != b]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def fingerprint(text: bytes | None, shingle_words: int = SHINGLE_WORDS, seed: int = SEED) -> int:
    """The signed 64-bit fingerprint of one whole text."""
    words = (text or b"").lower().split()  # bytes: only A-Z fold, only ASCII white space splits
    if not words:
        return 0
    if len(words) <= shingle_words:
        return _signed(xxhash.xxh64_intdigest(b" ".join(words), seed))
    joined, hash64 = b" ".join(words), xxhash.xxh64_intdigest
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = len(words) - shingle_words + 1
    ones = np.zeros(64, np.int64)
    for lo in range(0, n, 1 << 16):
        hi = min(n, lo + (1 << 16))
        pairs = zip(starts[lo:hi].tolist(), ends[lo + shingle_words - 1 : hi + shingle_words - 1].tolist(), strict=True)
        h = np.fromiter((hash64(joined[s:e], seed) for s, e in pairs), np.dtype("<u8"), hi - lo)
        # bits in groups of 255 rows, whose counts fit a byte
        bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        for at in range(0, len(bits), 255):
            ones += bits[at : at + 255].sum(axis=0, dtype=np.uint8)
    value = sum(1 << i for i in range(64) if 2 * int(ones[i]) > n)
    return _signed(value)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, fp)`` of every row, whole texts; null and wordless texts have fingerprint zero."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = [fingerprint(t.as_py()) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps, pa.int64())], ["id", "fp"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("binary").alias("t"))
    return rows.mapInArrow(run, "id long, fp long")


def _near(u: Column, v: Column) -> Column:
    return F.bit_count(u.bitwiseXOR(v)) <= MAX_BITS


def links(distinct: DataFrame) -> DataFrame:
    """``distinct(fp)`` without repeats -> edges ``(u, v)`` with the components of all links."""
    fp = F.col("fp")
    postings = distinct.select("fp", F.posexplode(F.array(*[fp.bitwiseAND(F.lit(_signed(m))) for m in LISTS])).alias("list", "key"))
    sizes = postings.groupBy("list", "key").agg(F.count("*").alias("n")).where("n > 1")
    shared = materialize(postings.join(sizes, ["list", "key"]).select("list", "key", "fp", "n"), "postings")

    short = shared.where(F.col("n") <= POSTING_PAIRS).groupBy("list", "key").agg(F.collect_list("fp").alias("all"))
    short = short.select(F.floor(F.col("list") / LISTS_A_MASK).alias("mask"), F.explode("all").alias("u"), "all")
    met = short.select("mask", "u", F.explode(F.filter("all", lambda v: v > F.col("u"))).alias("v"))
    # bytes of the mask, and one more for each list that the pair meets in
    tally = met.groupBy("mask", "u", "v").agg((F.lit(BYTES - LISTS_A_MASK) + F.count("*")).alias("bytes"))
    pairs = tally.where(F.col("bytes") >= BYTES - MAX_BITS).where(_near(F.col("u"), F.col("v"))).select("u", "v")

    long = shared.where(F.col("n") > POSTING_PAIRS).select("fp").distinct()
    words = F.array(fp, *[fp.bitwiseXOR(F.lit(_signed(1 << i))) for i in range(64)])
    balls = long.select("fp", F.explode(words).alias("word")).groupBy("word")
    stars = balls.agg(F.min("fp").alias("u"), F.collect_list("fp").alias("all")).where(F.size("all") > 1)
    stars = stars.select("u", F.explode(F.filter("all", lambda v: (v > F.col("u")) & _near(F.col("u"), v))).alias("v"))
    return pairs.union(stars).distinct()


def wide_postings(fps: DataFrame) -> DataFrame:
    """``(id, gram)`` of ``fps(id, fp)``: the lists of three positional bytes that a fingerprint is in, as hashes.

    Fingerprints that differ in three bits or fewer always share some: three bytes at most differ, so one of
    four blocks is whole and three of the other six bytes are. Beyond, those that ``wide_meet`` says.
    """
    lists = F.array(*[F.xxhash64(F.lit(i), F.col("fp").bitwiseAND(F.lit(_signed(m)))) for i, m in enumerate(WIDE_LISTS)])
    return fps.select("id", F.explode(lists).alias("gram"))


def wide_meet(u: str, v: str) -> str:
    """SQL that tells whether two fingerprints share a list of ``wide_postings``."""
    return "(" + " or ".join(f"(({u} ^ {v}) & {_signed(m)}L) = 0" for m in WIDE_LISTS) + ")"


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, fp, component)``: one row per row of ``docs``.

    ``component`` is the least id reachable over links of at most two differing bits. Null
    and empty texts have fingerprint zero and link like any other. Rows with a null id are
    kept and take part, but name a component only if it has no other row (then null).
    Repeated rows stay. Other columns are ignored, whatever their names; an empty table gives
    an empty result.
    """
    fps = materialize(fingerprints(docs, id_col, text_col), "fingerprints")
    distinct = fps.groupBy("fp").agg(F.min("id").alias("least"))
    roots = connected_components(links(distinct.select("fp")))
    member = distinct.join(roots, distinct.fp == roots.node, "left").select(
        "fp", "least", F.coalesce("root", "fp").alias("root")
    )
    named = member.join(member.groupBy("root").agg(F.min("least").alias("component")), "root")
    return fps.join(named.select("fp", "component"), "fp").select("id", "fp", "component")


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_duplicates(table(spark, sf_dir, "documents"))
    return out.select(
        F.col("id").alias("doc_id"),
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        F.col("component").alias("component_id"),
    )
