"""Token lengths, and their exact histogram with suffix sums for every context limit."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pressmill.llm.common import materialize, offsets, table

BYTE_BPE = "byte_bpe_50k.tiktoken"
#: Lengths in one block of the two-level suffix sums.
BLOCK = 256


def vocabulary_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@cache
def encoding(path: str):
    """The byte-level BPE of a rank file; one for each worker process."""
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("byte_bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_lengths(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = BYTE_BPE
) -> DataFrame:
    """``(id, n)``: tokens of each whole text; null and empty texts have none. One row for each row, whatever its id.

    Other columns are ignored; an empty table gives no rows.
    ``vocabulary`` names a rank file of the installed tokenizer package, or is a path that
    every executor can open.
    """
    path = vocabulary if "/" in vocabulary else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = encoding(path or vocabulary_path(vocabulary)).encode_ordinary
        for b in batches:
            n = [len(count(t.as_py() or "")) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64())], ["id", "n"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("t"))
    return rows.mapInArrow(run, "id long, n long")


def length_histogram(lengths: DataFrame, n_col: str = "n") -> DataFrame:
    """One row for each length that occurs, with what every context limit of that length gives.

    ``docs`` have the length; ``docs_upto`` and ``docs_over`` are at most and longer than it,
    ``tokens_upto`` is the sum of the former's lengths; ``truncated_tokens`` is what a limit of
    this length leaves of the corpus, ``lost_tokens`` what it cuts; ``quantile`` is the share of
    documents that fit. Null lengths are left out, other columns ignored; an empty table gives no rows.

    The histogram is aggregated before anything is ordered. Sums over lengths are taken in
    blocks of ``BLOCK`` lengths, then over the blocks: a summary of the longest length over
    ``BLOCK`` rows, whatever the number of documents.
    """
    n = F.col("n")
    hist = lengths.select(F.col(n_col).cast("long").alias("n")).where(n.isNotNull())
    # written, else the texts would be encoded for the sums over blocks and again for the rows
    hist = materialize(hist.groupBy("n").agg(F.count("*").alias("docs")), "histogram")
    hist = hist.withColumn("tokens", n * F.col("docs")).withColumn("block", F.floor(n / BLOCK))
    blocks = hist.groupBy("block").agg(F.sum("docs").alias("bd"), F.sum("tokens").alias("bt"))
    blocks = offsets(offsets(blocks, ["block"], "bd", "docs_before"), ["block"], "bt", "tokens_before")
    whole = Window.partitionBy()
    blocks = blocks.select(
        "block", "docs_before", "tokens_before", F.sum("bd").over(whole).alias("all_docs"), F.sum("bt").over(whole).alias("all_tokens")
    )
    run = Window.partitionBy("block").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    out = hist.join(blocks, "block").select(
        n.alias("n_tokens"),
        "docs",
        (F.col("docs_before") + F.sum("docs").over(run)).alias("docs_upto"),
        (F.col("tokens_before") + F.sum("tokens").over(run)).alias("tokens_upto"),
        "all_docs",
        "all_tokens",
    )
    kept = F.col("tokens_upto") + F.col("n_tokens") * F.col("docs_over")
    return (
        out.withColumn("docs_over", F.col("all_docs") - F.col("docs_upto"))
        .withColumn("truncated_tokens", kept)
        .withColumn("lost_tokens", F.col("all_tokens") - kept)
        .withColumn("quantile", F.col("docs_upto") / F.col("all_docs"))
        .drop("all_docs", "all_tokens")
    )


def tokens_at_limit(histogram: DataFrame, limit: int) -> int:
    """Tokens that truncation at ``limit`` leaves, for any limit, from the sums of the greatest length within it."""
    below = F.max(F.when(F.col("n_tokens") <= limit, F.struct("n_tokens", "tokens_upto", "docs_over"))).alias("below")
    r = histogram.agg(below, F.max(F.col("docs_upto")).alias("all")).first()
    if r["all"] is None:
        return 0
    return r["below"]["tokens_upto"] + limit * r["below"]["docs_over"] if r["below"] else limit * r["all"]


def length_quantile(histogram: DataFrame, share: float) -> int | None:
    """The least length that at least ``share`` of the documents do not exceed."""
    return histogram.where(F.col("quantile") >= share).agg(F.min("n_tokens")).first()[0]


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return length_histogram(token_lengths(table(spark, sf_dir, "documents")))
