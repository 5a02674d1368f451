"""Exact top-k inner products by an impact-ordered, score-at-a-time index.

Components are quantised to integers, the impacts. Candidates are dealt into blocks of about
``BLOCK_ROWS``, alike ones together: by the best of ``PIVOTS`` rows drawn by a hash, which shape blocks
and bear on no result. In a block each dimension has posting lists (row, impact) ordered by descending size of the
impact, cut into segments at powers of two. A batch of queries processes the segments in
that order; lists that hold many of the rows are laid side by side and added as a product, others one at a
time. What a row has not yet had processed has a known length, and by the Cauchy-Schwarz inequality that
length times the query's bounds what it can still add to or take from a score. From the segment on after
which these lengths are short enough to prove something, a query stops when the bounds prove that few rows
are left that can be members; these are then rescored exactly in integers.

Blocks are searched in two waves. In the first a query visits the block whose summary (mean and radius)
promises most, and its k-th best score there is a threshold for all others: in the second it visits only
blocks whose summary can still reach it, and begins there with the threshold. So a query is sent to the
blocks that can matter and no others; where summaries cannot tell blocks apart, that is all of them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pressmill.llm.common import materialize, table

SCALE = 64
K = 20
BLOCK_ROWS = 8192
#: Blocks at most; beyond, blocks are larger. Their summaries are broadcast, (dimensions + 2) * 8 bytes each.
MAX_BLOCKS = 65_536
QUERY_ROWS = 512
#: Rows that shape the blocks, at most.
PIVOTS = 64
#: Blocks whose summaries are compared at once.
SUMMARY_ROWS = 4096
#: Possible members of a query, times k, at which it stops; or one row in so many, as rescoring then costs less.
ENOUGH, RESCORED = 4, 32
#: Share of the rows' lengths that may be unprocessed at a proof: more proves nothing where rows are not alike.
PROVABLE = 0.25
#: Posting lists with a row in so many are laid out with a place for every row, to be added many at a time.
FULL = 128
#: Scores held at once: they stay in the processor's cache.
SCORES = 1 << 18
#: Scores and partial scores below this are exact integers in single precision.
EXACT32 = float(1 << 22)
#: Scores from here on could leave the range of a long; floating-point bounds say nothing about them.
LARGEST = float(1 << 62)
#: Relative error that bounds allow for rounding.
ROUNDING = 1e-9


class ImpactIndex:
    """Candidates of one block, their postings by dimension in impact order."""

    def __init__(self, ids: np.ndarray, x: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.ids, self.x = ids[order], x[order]
        size = np.abs(self.x)
        self.top = int(size.max(initial=0))
        #: by segment: least impact, [(dimension, rows, impacts)], and the length of what each row has after it
        self.segments: list[tuple[int, list[tuple[int, np.ndarray, np.ndarray]], np.ndarray]] = []
        low = 1 << max(0, self.top.bit_length() - 1)
        while low >= 1 and self.top:
            inside = (size >= low) & (size < 2 * low)
            lists = []
            for d in np.nonzero(inside.any(axis=0))[0]:
                rows = np.nonzero(inside[:, d])[0].astype(np.int32)
                rows = rows[np.argsort(-size[rows, d], kind="stable")]
                lists.append((int(d), rows, self.x[rows, d].astype(np.float64)))
            rest = np.where(size < low, self.x, 0).astype(np.float64)
            self.segments.append((low, lists, np.sqrt((rest * rest).sum(axis=1))))
            low //= 2
        self.length = np.sqrt((self.x.astype(np.float64) ** 2).sum(axis=1))
        #: last segments of the steps after which a proof is tried: before, what is unprocessed is too long to prove anything
        short = [i for i, (*_, rest) in enumerate(self.segments) if rest.sum() <= PROVABLE * self.length.sum()]
        self.steps = [(lo, hi) for lo, hi in zip([0, *(i + 1 for i in short)], [i + 1 for i in short], strict=False)]
        self._laid: dict[tuple[int, type], tuple[list[int], np.ndarray, list[tuple[int, np.ndarray, np.ndarray]], int]] = {}

    def _step(self, step: int, kind: type) -> tuple[list[int], np.ndarray, list[tuple[int, np.ndarray, np.ndarray]], int]:
        """A step's posting lists: dimensions of the full ones, these side by side, the others, and the number of postings."""
        if (step, kind) not in self._laid:
            lists = [posted for _, lists, _ in self.segments[slice(*self.steps[step])] for posted in lists]
            count: dict[int, int] = {}
            for d, rows, _ in lists:
                count[d] = count.get(d, 0) + len(rows)
            full = sorted(d for d, c in count.items() if c * FULL >= len(self.ids))
            place, side = {d: i for i, d in enumerate(full)}, np.zeros((len(full), len(self.ids)), kind)
            for d, rows, impact in lists:
                if d in place:
                    side[place[d], rows] = impact
            self._laid[step, kind] = full, side, [p for p in lists if p[0] not in place], sum(count.values())
        return self._laid[step, kind]

    def search(
        self, ids: np.ndarray, q: np.ndarray, k: int, least: np.ndarray | None = None
    ) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """``(query, row, score)``: places of a batch's queries and of this block's rows, every query's k best.

        Rows with the query's id are left out; ties go to the smaller id. Rows below ``least``, a
        query's threshold, may be left out. Also gives for each query how many postings were processed.
        """
        weight = q.astype(np.float64)
        norm = np.sqrt((weight * weight).sum(axis=1))
        n, seen = len(self.ids), np.zeros(len(q), np.int64)
        bar = np.full(len(q), -np.inf) if least is None else least.astype(np.float64)
        longest = norm.max(initial=0) * self.length.max(initial=0)
        if not n or longest >= LARGEST:
            query, row = np.nonzero(self.ids[None, :] != ids[:, None])
            return *self._best(q, query, row, k), seen
        kind = np.float32 if longest < EXACT32 else np.float64  # sums of integers as small are exact
        # a query whose threshold is out of reach processes nothing
        asks = np.nonzero(bar <= norm * self.length.max() * (1 + ROUNDING))[0]
        own = np.searchsorted(self.ids, ids, "left"), np.searchsorted(self.ids, ids, "right")
        kept = [(np.empty(0, np.int64), np.empty(0, np.int64))]
        some = max(16, SCORES // n)
        for at in range(0, len(asks), some):
            kept += self._possible(asks[at : at + some], weight, norm, bar, own, k, kind, seen)
        query, row = (np.concatenate(c) for c in zip(*kept, strict=True))
        return *self._best(q, query, row, k, bar), seen

    def _possible(
        self, open_: np.ndarray, weight: np.ndarray, norm: np.ndarray, bar: np.ndarray, own: tuple[np.ndarray, np.ndarray], k: int, kind: type, seen: np.ndarray
    ) -> list[tuple[np.ndarray, np.ndarray]]:
        """``(query, row)`` that can be among a query's k best, for the queries ``open_``."""
        n, out, score = len(self.ids), [], np.zeros((len(open_), len(self.ids)), kind)
        enough, k_here = max(ENOUGH * k, n // RESCORED), min(k, n)
        for step in range(len(self.steps)):
            full, side, single, postings = self._step(step, kind)
            w = weight[open_].astype(kind)
            if full:
                score += w[:, full] @ side
            for d, rows, impact in single:
                score[:, rows] += w[:, d, None] * impact.astype(kind)
            seen[open_] += postings
            rest = self.segments[self.steps[step][1] - 1][2]
            if kind is np.float32:  # bounds are rounded, scores are not; both are below 2 ** 22, so less than 1 is lost
                slack = (norm[open_] * (1 + 1e-6)).astype(kind)[:, None] * (rest * (1 + 1e-6)).astype(kind)
                lost = 1
            else:
                slack = norm[open_, None] * rest + ROUNDING * norm[open_, None] * self.length
                lost = 0
            least = (bar[open_] - lost).astype(kind)
            possible = score + slack >= least[:, None]
            for i, (lo, hi) in enumerate(zip(own[0][open_], own[1][open_], strict=True)):
                possible[i, lo:hi] = False
            count = np.count_nonzero(possible, axis=1)
            if len(many := np.nonzero(count > enough)[0]):  # the k-th lower bound of the block may say more
                lower = np.where(possible[many], score[many] - slack[many], -np.inf)
                kth = np.partition(lower, n - k_here, axis=1)[:, n - k_here] - lost
                possible[many] &= score[many] + slack[many] >= kth[:, None]
                count[many] = np.count_nonzero(possible[many], axis=1)
            done = count <= enough
            if step == len(self.steps) - 1:
                done[:] = True
            query, row = np.nonzero(possible[done]) if not done.all() else np.nonzero(possible)
            out.append((open_[done][query], row))
            if done.all():
                return out
            open_, score = open_[~done], score[~done]
        # all impacts are zero: nothing to process
        query, row = np.nonzero((np.arange(n) < own[0][open_, None]) | (np.arange(n) >= own[1][open_, None]))
        return [*out, (open_[query], row)]

    def _best(
        self, q: np.ndarray, query: np.ndarray, row: np.ndarray, k: int, bar: np.ndarray | None = None
    ) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        score = np.empty(len(query), np.int64)
        for at in range(0, len(query), 1 << 12):
            part = slice(at, at + (1 << 12))
            score[part] = np.einsum("ij,ij->i", q[query[part]], self.x[row[part]])
        if bar is not None:
            reach = score >= bar[query]
            query, row, score = query[reach], row[reach], score[reach]
        order = np.lexsort((self.ids[row], -score, query))
        query, row, score = query[order], row[order], score[order]
        first = np.concatenate(([0], np.nonzero(np.diff(query))[0] + 1)) if len(query) else np.empty(0, int)
        keep = np.arange(len(query)) - np.repeat(first, np.diff(np.append(first, len(query)))) < k
        return query[keep], row[keep], score[keep]


def quantised(vectors: DataFrame, id_col: str, vector_col: str, scale: int = SCALE) -> DataFrame:
    """``(id, x)``: one row for each row, components ``floor(scale * component)``.

    Rows that share an id stay apart. Vectors that are null or hold a null or non-finite component, and
    null ids, take no part. Components beyond the range of a long saturate. Other columns are ignored.
    """
    v = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    sound = F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    v = v.where(F.col("id").isNotNull() & F.col("v").isNotNull() & sound)
    limit = float(1 << 62)
    return v.select("id", F.transform("v", lambda c: F.floor(F.greatest(F.least(c * scale, F.lit(limit)), F.lit(-limit)))).alias("x"))


def _matrix(lists: pa.Array, width: int) -> np.ndarray:
    """Rows of a list array as a matrix; shorter ones end in zeros, longer ones are cut."""
    lengths = np.diff(lists.offsets.to_numpy())
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    out = np.zeros((len(lists), max(width, int(lengths.max(initial=0)))), np.int64)
    out[np.arange(out.shape[1])[None, :] < lengths[:, None]] = flat
    return out[:, :width]


def _blocks(rows: DataFrame, width: int, total: int, block_rows: int) -> DataFrame:
    """``(block, id, x)``: rows dealt by their best pivot, and a pivot's rows over as many blocks as they need."""
    pivots = rows.orderBy(F.xxhash64("id", F.lit("pivot")), "id").limit(max(1, min(PIVOTS, total // block_rows))).select("x").toArrow()
    sent = rows.sparkSession.sparkContext.broadcast(_matrix(pivots["x"].combine_chunks(), width).astype(np.float64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        length = np.sqrt((sent.value**2).sum(axis=1))
        directions = (sent.value / np.maximum(length, 1e-300)[:, None]).T
        for b in batches:
            best = (_matrix(b.column("x"), width).astype(np.float64) @ directions).argmax(axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(best.astype(np.int32)), b.column("id"), b.column("x")], ["pivot", "id", "x"])

    dealt = materialize(rows.mapInArrow(run, "pivot int, id long, x array<long>"), "dealt")
    # at most PIVOTS rows
    sizes = dealt.groupBy("pivot").agg(F.ceil(F.count("*") / block_rows).alias("parts"))
    before = F.coalesce(F.sum("parts").over(Window.orderBy("pivot").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = materialize(sizes.select("pivot", "parts", before.alias("first")), "sizes")
    part = F.pmod(F.xxhash64("id", "x"), F.col("parts"))
    return dealt.join(F.broadcast(sizes), "pivot").select((F.col("first") + part).cast("int").alias("block"), "id", "x")


def _summaries(blocks: DataFrame, width: int) -> DataFrame:
    """``(block, mean, radius)``: every row of a block lies within ``radius`` of ``mean``."""
    at = blocks.select("block", F.posexplode("x").alias("d", "v")).groupBy("block", "d").agg(F.sum(F.col("v").cast("double")).alias("s"))
    sizes = blocks.groupBy("block").agg(F.count("*").alias("n"))
    means = at.join(sizes, "block").groupBy("block").agg(F.collect_list(F.struct("d", (F.col("s") / F.col("n")).alias("m"))).alias("all"))
    filled = F.aggregate("all", F.array_repeat(F.lit(0.0), width), lambda a, e: F.transform(a, lambda v, i: F.when(i == e["d"], e["m"]).otherwise(v)))
    means = sizes.select("block").join(means, "block", "left").select("block", F.coalesce(filled, F.array_repeat(F.lit(0.0), width)).alias("mean"))
    means = materialize(means, "means")
    # shorter vectors end in zeros
    apart = F.aggregate(F.zip_with("x", "mean", lambda v, m: F.pow(F.coalesce(v, F.lit(0)) - m, F.lit(2))), F.lit(0.0), lambda a, v: a + v)
    reach = blocks.join(means, "block").groupBy("block").agg(F.sqrt(F.max(apart)).alias("radius"))
    return means.join(reach, "block")


def _visits(queries: DataFrame, summaries: DataFrame, width: int, first: bool) -> DataFrame:
    """``(block, qn, id, x, least)``: the most promising block of each query, or all others that can reach its threshold."""
    parts = [r.asDict() for r in summaries.select("block", "mean", "radius").toLocalIterator()]
    sent = queries.sparkSession.sparkContext.broadcast((
        np.array([p["block"] for p in parts], np.int32), np.array([p["mean"] for p in parts]).reshape(-1, width), np.array([p["radius"] for p in parts]),
    ))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, mean, radius = sent.value
        for b in batches:
            q = _matrix(b.column("x"), width).astype(np.float64)
            norm = np.sqrt((q * q).sum(axis=1))
            best = np.full(len(q), -np.inf)
            home = np.zeros(len(q), np.int32)
            for at in range(0, len(block), SUMMARY_ROWS):
                piece = slice(at, at + SUMMARY_ROWS)
                reach = q @ mean[piece].T + norm[:, None] * radius[piece]
                if first:
                    top = reach.argmax(axis=1)
                    better = reach[np.arange(len(q)), top] > best
                    home[better], best[better] = block[piece][top[better]], reach[np.arange(len(q)), top][better]
                    continue
                reach += ROUNDING * (np.abs(q) @ np.abs(mean[piece]).T + norm[:, None] * radius[piece])
                bar = b.column("least").to_numpy(zero_copy_only=False).astype(np.float64)
                own = np.where(np.isnan(bar), -np.inf, bar)
                row, to = np.nonzero((reach >= own[:, None]) & (block[piece][None, :] != b.column("block").to_numpy()[:, None]))
                for lo in range(0, len(row), 4096):
                    some = pa.array(row[lo : lo + 4096])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(block[piece][to[lo : lo + 4096]]), *(b.column(c).take(some) for c in ("qn", "id", "x", "least"))], ["block", "qn", "id", "x", "least"]
                    )
            if first:
                none = pa.array(np.full(len(q), np.nan))
                yield pa.RecordBatch.from_arrays([pa.array(home), b.column("qn"), b.column("id"), b.column("x"), none], ["block", "qn", "id", "x", "least"])

    return queries.mapInArrow(run, "block int, qn long, id long, x array<long>, least double")


def _searched(blocks: DataFrame, visits: DataFrame, width: int, k: int) -> DataFrame:
    """``(qn, query_id, block, id, score)``: the best of each visited block."""
    none = F.lit(None)
    cand = blocks.select("block", F.lit(0).alias("kind"), none.cast("long").alias("qn"), "id", "x", none.cast("double").alias("least"))
    asked = visits.select("block", F.lit(1).alias("kind"), "qn", "id", "x", "least")
    dealt = cand.unionByName(asked).repartition("block").sortWithinPartitions("block", "kind")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, index = None, [], None
        for batch in batches:
            blocks_, kinds = batch.column("block").to_numpy(), batch.column("kind").to_numpy()
            cuts = np.nonzero((np.diff(blocks_) != 0) | (np.diff(kinds) != 0))[0] + 1
            for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows], strict=True):
                part, block, kind = batch.slice(lo, hi - lo), int(blocks_[lo]), int(kinds[lo])
                if block != at:
                    at, held, index = block, [], None
                if kind == 0:
                    held.append((part.column("id").to_numpy(), _matrix(part.column("x"), width)))
                    continue
                if index is None:
                    index, held = ImpactIndex(*(np.concatenate(c) for c in zip(*held, strict=True))), []
                for j in range(0, part.num_rows, QUERY_ROWS):
                    some = part.slice(j, QUERY_ROWS)
                    ids, bar = some.column("id").to_numpy(), some.column("least").to_numpy(zero_copy_only=False)
                    bar = np.where(np.isnan(bar), -np.inf, bar)
                    query, row, score, _ = index.search(ids, _matrix(some.column("x"), width), k, bar)
                    yield pa.RecordBatch.from_arrays(
                        [some.column("qn").take(pa.array(query)), pa.array(ids[query]), pa.array(np.full(len(query), block, np.int32)), pa.array(index.ids[row]), pa.array(score)],
                        ["qn", "query_id", "block", "id", "score"],
                    )

    return dealt.mapInArrow(run, "qn long, query_id long, block int, id long, score long")


def top_k(rows: DataFrame, queries: DataFrame, k: int = K, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``(query_id, rank, id, score)``: for each query id the k best rows with another id.

    Both sides are ``(id, x)`` as ``quantised`` gives them; other columns are ignored. Shorter vectors count as ended
    by zeros. Every row of a repeated id is a candidate, and of a repeated query id every row asks. Ties
    go to the smaller id. A query with fewer other rows gets all of them; either side empty gives
    an empty result.
    """
    rows, total = rows.select("id", "x"), rows.count()
    block_rows = max(block_rows, -(-total // MAX_BLOCKS))
    width = max(1, rows.agg(F.max(F.size("x"))).first()[0] or 1)
    blocks = materialize(_blocks(rows, width, total, block_rows), "blocks") if total else rows.withColumn("block", F.lit(0)).limit(0)
    summaries = materialize(_summaries(blocks, width), "summaries")
    asked = materialize(queries.select(F.monotonically_increasing_id().alias("qn"), "id", "x"), "queries")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    if not total:
        found = asked.select(F.col("id").alias("query_id"), "id", F.lit(0).cast("long").alias("score")).limit(0)
    else:
        found = materialize(_searched(blocks, _visits(asked, summaries, width, True), width, k), "first")
        # the k-th score of the first block, if it had so many rows
        own = found.groupBy("qn").agg(F.when(F.count("*") >= k, F.min("score")).cast("double").alias("least"), F.max("block").alias("block"))
        # a query that found nothing at home (alone there) goes everywhere
        open_ = asked.join(own, "qn", "left").select("qn", "id", "x", "least", F.coalesce("block", F.lit(-1)).alias("block"))
        rest = _searched(blocks, _visits(open_, summaries, width, False), width, k)
        found = found.union(rest).select("query_id", "id", "score")
    ranked = found.withColumn("rank", F.row_number().over(best))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "id", "score")


def op4_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = materialize(quantised(table(spark, sf_dir, "embeddings"), "vec_id", "embedding"), "vectors")
    return top_k(rows, rows.where(F.col("id") % 20 == 0)).withColumnRenamed("id", "vec_id")


ORACLE_SQL = f"""with x as (select vec_id, list_transform(embedding, lambda c: floor({SCALE} * c::double)) as v from embeddings
    where embedding is not null and len(list_filter(embedding, lambda c: c is null or not isfinite(c))) = 0),
    scores as (select q.vec_id as query_id, c.vec_id, list_inner_product(q.v, c.v)::bigint as score
        from x q join x c on q.vec_id % 20 = 0 and q.vec_id <> c.vec_id)
select query_id, row_number() over (partition by query_id order by score desc, vec_id)::int as rank, vec_id, score from scores qualify rank <= {K}"""
