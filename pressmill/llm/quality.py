"""Quality classification by co-training a text view and a page-metadata view.

The text view sees the text alone: hashed four-byte sequences of the whole text, how concentrated they
are, how often they come again soon, its lines, and its shares of capitals, digits and marks. The
metadata view sees nothing of the text: language, source, the two together, and the declared
size. Both are logistic models. In each round both score every unlabelled document, and each
view hands rows it is sure of, in the classes' proportion, to the other as labelled ones. Labelled
rows that train nothing calibrate each view and both together, others set the threshold;
every document is scored by the calibrated combination.

Only the fits work on bounded samples of labelled rows: about ``MAX_LABELLED`` given labels, and in
each round about ``EXCHANGED`` labels from each view, drawn by a hash of the id from all rows that it is sure of.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pressmill.llm.bytes import byte_rows, echoes, gram_codes, sums
from pressmill.llm.common import discard, handing_back, materialize, table
from pressmill.operators.keys import first_per_key

MAX_LABELLED = 8000
GRAM_BITS = 9
KEY_BUCKETS = 32
ROUNDS = 4
#: Rows a view labels in a round, about, and how sure it must be.
EXCHANGED = 800
SURE = 0.95
RIDGE = 0.3
#: Share of held-out good documents that the threshold may reject.
LOST_GOOD = 0.01
#: A document is never rejected at this score or above.
MAX_THRESHOLD = 0.5

_DIGIT, _UPPER, _SPACE, _MARK = (np.zeros(256, bool) for _ in range(4))
_DIGIT[48:58] = _UPPER[65:91] = True
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_MARK[33:127] = True
_MARK &= ~np.array([chr(i).isalnum() if i < 128 else False for i in range(256)])
_PLAIN = np.zeros(256, bool)
_PLAIN[[ord(c) for c in ".,;:'\"-?!()"]] = True
#: Distances at which a repeated word comes again.
LAGS = range(2, 25)
#: Concentration of ordinary long text; what is above it and above a short text's own is repetition.
USUAL = 0.006
#: Classes of the declared size, by powers of two.
SIZE_CLASSES = 24
TEXT_WIDTH = (1 << GRAM_BITS) + 12
META_WIDTH = 3 * KEY_BUCKETS + SIZE_CLASSES + 2


def features(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Text and metadata features of rows ``(text, lang, source, n_chars)``; neither view sees what the other does."""
    n, width = batch.num_rows, 1 << GRAM_BITS
    grams, shape, again = np.zeros((n, width), np.float32), np.zeros((n, 7)), np.zeros(n)
    for data, starts, rows in byte_rows(batch.column("text")):
        full = gram_codes(data, 32, starts)
        again[rows] += echoes(full, starts, LAGS)
        codes = (full >> np.uint32(32 - GRAM_BITS)).astype(np.int64)
        codes += np.repeat(np.arange(len(rows)) * width, np.diff(starts))
        grams[rows] += np.bincount(codes, minlength=len(rows) * width).reshape(len(rows), width)
        shape[rows, 0] += np.diff(starts)
        shape[rows, 1] += sums(data == 10, starts)
        for k, kind in enumerate((_DIGIT, _UPPER, _SPACE, _MARK, _PLAIN)):
            shape[rows, 2 + k] += sums(kind[data], starts)
    size = np.maximum(shape[:, 0], 1)
    share = grams / size[:, None].astype(np.float32)
    alike = (share**2).sum(axis=1)
    excess = np.log((alike + 1e-6) / (1 / size + USUAL))
    shares = shape[:, 1:] / size[:, None]
    look = [np.log(alike + 1e-4), excess, (share > 0).mean(axis=1), np.sqrt(again / size), np.log1p(size), np.log(size / (1 + shape[:, 1]))]
    text = np.concatenate((np.sqrt(share), np.stack([*look, *np.sqrt(shares).T[1:], shape[:, 0] == 0], axis=1)), axis=1)
    return text.astype(np.float32), _metadata(batch)


def _metadata(batch: pa.RecordBatch) -> np.ndarray:
    """Language, source, both together (a bucket each), and the declared size; nulls have buckets of their own."""
    out = np.zeros((batch.num_rows, META_WIDTH), np.float32)
    langs, sources, sizes = (batch.column(c).to_pylist() for c in ("lang", "source", "n_chars"))
    at = 3 * KEY_BUCKETS
    for i, (lang, source, n) in enumerate(zip(langs, sources, sizes, strict=True)):
        for block, key in enumerate((lang, source, None if lang is None or source is None else f"{lang}\0{source}")):
            out[i, block * KEY_BUCKETS + (1 + zlib.crc32(key.encode()) % (KEY_BUCKETS - 1) if key is not None else 0)] = 1
        if n is not None:
            out[i, at + min(SIZE_CLASSES - 1, max(0, n).bit_length())] = 1
            out[i, -2] = np.log1p(max(0, n))
        out[i, -1] = n is None
    return out


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


@dataclass
class Linear:
    """A logistic model over standardised features, fitted by Newton steps with a ridge."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, ridge: float = RIDGE, steps: int = 8) -> Linear:
        mean, scale = x.mean(axis=0), x.std(axis=0)
        scale[scale < 1e-6] = 1
        x = np.concatenate(((x - mean) / scale, np.ones((len(x), 1), np.float32)), axis=1).astype(np.float32)
        w, penalty = np.zeros(x.shape[1]), np.full(x.shape[1], ridge)
        penalty[-1] = 1e-6
        penalty[:-1] *= max(1.0, len(x) / 100)
        for _ in range(steps):
            p = _sigmoid(x @ w.astype(np.float32))
            curve = np.maximum(p * (1 - p), 1e-4).astype(np.float32)
            hess = (x.T @ (x * curve[:, None])).astype(np.float64) + np.diag(penalty)
            step = np.linalg.solve(hess, x.T @ (y - p) - penalty * w)
            w += step
            if np.abs(step).max() < 1e-3:
                break
        return cls(mean, scale, w)

    def logit(self, x: np.ndarray) -> np.ndarray:
        return ((x - self.mean) / self.scale) @ self.weights[:-1] + self.weights[-1]


def calibration(z: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Slopes (never negative) and offset that turn scores, a column each, into log-odds, by Platt's method.

    Newton steps on the smoothed targets with a small pull to the mean of the scores, halved
    until they help; a column that would get a negative slope is left out.
    """
    z = z.reshape(len(y), -1)
    good, bad = y.sum(), len(y) - y.sum()
    target = np.where(y > 0.5, (good + 1) / (good + 2), 1 / (bad + 2))
    use = np.ones(z.shape[1] + 1, bool)
    while True:
        x = np.concatenate((z, np.ones((len(z), 1))), axis=1)[:, use]
        rest = np.append(np.full(use.sum() - 1, 1 / max(1, use.sum() - 1)), 0.0)
        w = rest.copy()

        def loss(w: np.ndarray, x: np.ndarray = x, rest: np.ndarray = rest) -> float:
            t = x @ w
            return float((np.logaddexp(0, t) - target * t).sum() + 0.5 * ((w - rest) ** 2).sum())

        for _ in range(50):
            p = _sigmoid(x @ w)
            hess = (x * (p * (1 - p))[:, None]).T @ x + np.eye(len(w))
            step, now = np.linalg.solve(hess, x.T @ (target - p) - (w - rest)), loss(w)
            while loss(w + step) > now and np.abs(step).max() > 1e-9:
                step = step / 2
            w = w + step
            if np.abs(step).max() < 1e-7:
                break
        if (w[:-1] >= 0).all():
            out = np.zeros(len(use))
            out[use] = w
            return out
        use[np.nonzero(use)[0][:-1][w[:-1] < 0]] = False


@dataclass
class CoTrained:
    """Two views, their calibrations, and the calibration of the two together."""

    views: tuple[Linear, Linear]
    scales: tuple[np.ndarray, np.ndarray]
    joint: np.ndarray
    threshold: float
    exchanged: list[tuple[int, int]]
    held_out: dict[str, float]

    def score(self, text: np.ndarray, meta: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Probabilities of good quality: text view, metadata view, both."""
        z = [a * v.logit(x) + b for v, x, (a, b) in zip(self.views, (text, meta), self.scales, strict=True)]
        return _sigmoid(z[0]), _sigmoid(z[1]), _sigmoid(self.joint[0] * z[0] + self.joint[1] * z[1] + self.joint[2])


#: Given both models, their calibrations, rows wanted by (view, label), and the round: what each view labels for the
#: other, as features and labels.
Given = tuple[np.ndarray, np.ndarray]
Exchange = Callable[[list[Linear], list[np.ndarray], dict[tuple[int, float], int], int], tuple[Given, Given]]
#: What a labelled row is for.
TRAIN, CALIBRATE, JUDGE = range(3)


def co_train(
    views: tuple[np.ndarray, np.ndarray], y: np.ndarray, part: np.ndarray, exchange: Exchange, rounds: int = ROUNDS, exchanged: int = EXCHANGED
) -> CoTrained | None:
    """Fits on the ``TRAIN`` rows and what the views label; None without both classes in every part.

    In each round the ``CALIBRATE`` rows turn a view's scores into probabilities, so a view that knows little is sure
    of nothing; a label it is sure of is only handed on if these rows bear it out as often as it claims. ``exchange`` gives for each view the other view's features of the rows it labels, and the
    labels. The ``JUDGE`` rows set the threshold and tell the accuracy.
    """
    if any(len(np.unique(y[part == p])) < 2 for p in (TRAIN, CALIBRATE, JUDGE)):
        return None
    learn, check, judge = (part == p for p in (TRAIN, CALIBRATE, JUDGE))
    share = float(y[learn].mean())
    sets = [[(x[learn], y[learn])] for x in views]
    history = []

    def fitted() -> tuple[list[Linear], list[np.ndarray]]:
        models = [Linear.fit(np.concatenate([x for x, _ in s]), np.concatenate([t for _, t in s])) for s in sets]
        return models, [calibration(m.logit(x[check]), y[check]) for m, x in zip(models, views, strict=True)]

    def wanted() -> dict[tuple[int, float], int]:
        out = {}
        for k, (m, x, (slope, at)) in enumerate(zip(models, views, scales, strict=True)):
            p = _sigmoid(slope * m.logit(x[check]) + at)
            for label, sure, rows in ((1.0, p >= SURE, share), (0.0, p <= 1 - SURE, 1 - share)):
                right = (y[check][sure] == label).sum()
                if (right + 0.5) / (sure.sum() + 1) >= SURE:
                    out[k, label] = max(1, round(exchanged * rows))
        return out

    models, scales = fitted()
    for nth in range(rounds):
        given = exchange(models, scales, wanted(), nth)
        for k in (0, 1):
            sets[1 - k].append(given[k])
        history.append(tuple(len(t) for _, t in given))
        if not sum(history[-1]):
            break
        models, scales = fitted()
    both = np.stack([a * m.logit(x[check]) + b for m, x, (a, b) in zip(models, views, scales, strict=True)], axis=1)
    out = CoTrained(tuple(models), tuple(scales), calibration(both, y[check]), 0.0, history, {})
    parts = out.score(views[0][judge], views[1][judge])
    good = np.sort(parts[2][y[judge] > 0.5])
    out.threshold = float(min(MAX_THRESHOLD, good[int(LOST_GOOD * len(good))]))
    for name, p in zip(("text", "metadata", "both"), parts, strict=True):
        out.held_out[name] = float(((p >= 0.5) == (y[judge] > 0.5)).mean())
    return out


def part_of(id_: int) -> int:
    """What a labelled document is for: half train, a quarter calibrates, a quarter judges."""
    return (TRAIN, TRAIN, CALIBRATE, JUDGE)[zlib.crc32(int(id_).to_bytes(8, "little", signed=True)) % 4]


def _draw(id_: Column, what: str, share: float) -> Column:
    return F.pmod(F.xxhash64(id_, F.lit(what)), F.lit(1 << 30)) < int(share * (1 << 30))


def _slices(batches: Iterator[pa.RecordBatch], rows: int = 1000) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)


def feature_rows(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``(id, doc, x)``: both views' features of every row, written; ``doc`` is what labels name."""
    rows = docs.select(
        F.col(id_col).cast("long").alias("id"), F.col("doc_id").cast("long").alias("doc"), F.col("text").cast("binary").alias("text"),
        F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"),
        F.col("n_chars").cast("long").alias("n_chars"),
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _slices(batches):
            both = np.concatenate(features(b), axis=1).astype("<f2")
            x = pa.array([r.tobytes() for r in both], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("doc"), x], ["id", "doc", "x"])

    return materialize(rows.mapInArrow(handing_back(run), "id long, doc long, x binary"), "features")


def _unpacked(x: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    both = np.frombuffer(b"".join(x.to_pylist()), "<f2").reshape(len(x), TEXT_WIDTH + META_WIDTH).astype(np.float32)
    return both[:, :TEXT_WIDTH], both[:, TEXT_WIDTH:]


def _chosen(rows: DataFrame, few: DataFrame) -> tuple[np.ndarray, tuple[np.ndarray, np.ndarray], np.ndarray]:
    """Ids, features and labels of ``few(doc, y)``, one row for each document, in order of the id."""
    found = rows.select("doc", "x").join(F.broadcast(few), "doc")
    found = first_per_key(found, "doc", [F.asc("x")]).toArrow()
    order = np.argsort(found["doc"].to_numpy(), kind="stable")
    found = found.take(pa.array(order))
    return found["doc"].to_numpy(), _unpacked(found["x"]), found["y"].to_numpy().astype(np.float64)


def train(rows: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED, exchanged: int = EXCHANGED) -> CoTrained | None:
    """The model over ``feature_rows``; fitted on the driver, the unlabelled rows scored where they are.

    A document labelled both ways counts as bad; null labels and ids are left out; of rows that share an
    id one is learnt from.
    """
    marked = labels.select(F.col("doc_id").cast("long").alias("doc"), F.col("quality").cast("double").alias("y"))
    marked = marked.where("doc is not null and y in (0, 1)")
    few = marked.where(_draw(F.col("doc"), "labelled", min(1.0, max_labelled / max(1, marked.count()))))
    ids, views, y = _chosen(rows, few.groupBy("doc").agg(F.min("y").alias("y")))
    if not len(ids):
        return None
    spark, gone = rows.sparkSession, []

    def exchange(models: list[Linear], scales: list[np.ndarray], wanted: dict[tuple[int, float], int], nth: int) -> tuple[Given, Given]:
        sent = spark.sparkContext.broadcast(list(zip(models, scales, strict=True)))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in _slices(batches):
                p = [_sigmoid(slope * m.logit(x) + at) for (m, (slope, at)), x in zip(sent.value, _unpacked(b.column("x")), strict=True)]
                for k in (0, 1):
                    for label, sure in ((1, p[k] >= SURE), (0, p[k] <= 1 - SURE)):
                        doc = b.column("doc").filter(pa.array(sure))
                        n = len(doc)
                        yield pa.RecordBatch.from_arrays([doc, pa.array(np.full(n, k, np.int32)), pa.array(np.full(n, float(label)))], ["doc", "view", "y"])

        # ids alone are shuffled here; labelled rows, and those given before, are not for giving
        sure = rows.where("doc is not null").select("doc", "x").mapInArrow(handing_back(run), "doc long, view int, y double")
        sure = sure.join(marked.select("doc"), "doc", "left_anti")
        if gone:
            sure = sure.join(F.broadcast(gone[0]), "doc", "left_anti")
        sure = materialize(sure, "sure")
        count = {(r["view"], r["y"]): r["n"] for r in sure.groupBy("view", "y").agg(F.count("*").alias("n")).collect()}
        out, new = [], []
        for k in (0, 1):
            drawn = sure.limit(0).select("doc", "y")
            for label in (1.0, 0.0):
                rate = min(1.0, wanted.get((k, label), 0) / max(1, count.get((k, label), 0)))
                drawn = drawn.union(sure.where((F.col("view") == k) & (F.col("y") == label)).where(_draw(F.col("doc"), f"given{nth}-{k}", rate)).select("doc", "y"))
            own, x, t = _chosen(rows, drawn.groupBy("doc").agg(F.min("y").alias("y")))
            out.append((x[1 - k], t))
            new += own.tolist()
        given = pa.table({"doc": pa.array([*(gone[0].toArrow()["doc"].to_pylist() if gone else []), *new], pa.int64())})
        gone[:] = [spark.createDataFrame(given)] if len(given) else []  # at most about 2 * EXCHANGED ids a round
        discard(sure)
        return tuple(out)

    return co_train(views, y, np.array([part_of(i) for i in ids]), exchange, exchanged=exchanged)


def classify(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED, id_col: str = "doc_id") -> DataFrame:
    """``(id, text_score, meta_score, score, accepted)``, one row per row of ``docs``.

    Null and empty texts are scored by what their metadata says and an all-zero text view;
    null metadata fall into buckets of their own. Repeated rows are scored alike. If the labels
    lack a class (or are empty), scores are null and every document is accepted. Columns
    other than ``doc_id text lang source n_chars`` and ``id_col`` are ignored; an empty table gives no rows.
    """
    rows = feature_rows(docs, id_col)
    model = train(rows, labels, max_labelled)
    if model is None:
        none = F.lit(None).cast("double")
        return rows.select("id", none.alias("text_score"), none.alias("meta_score"), none.alias("score"), F.lit(True).alias("accepted"))
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for b in _slices(batches):
            scores = [np.round(s.astype(np.float64), 9) for s in model.score(*_unpacked(b.column("x")))]
            yield pa.RecordBatch.from_arrays(
                [b.column("id"), *(pa.array(s) for s in scores), pa.array(scores[2] >= model.threshold)],
                ["id", "text_score", "meta_score", "score", "accepted"],
            )

    return rows.select("id", "x").mapInArrow(handing_back(run), "id long, text_score double, meta_score double, score double, accepted boolean")


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.withColumnRenamed("id", "doc_id")
