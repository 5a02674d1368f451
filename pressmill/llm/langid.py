"""Language identification by Bayesian fusion of text, declared language, address and host.

Text likelihoods come from hashed four-byte sequences of the whole text under one multinomial
model for each language, fitted on rows that declare a language. The other evidence is a key
(the declared markup language, the address suffix, the host): grouped aggregation sums the
text posteriors of all rows that share it, and the sums give P(language | key), smoothed
towards the corpus, or for hosts towards their domain and that towards the corpus. A row's own
share is taken out before its keys testify for it. Shares under ``TRACE`` are not counted. With the corpus prior P(l), the fused
log-odds are ``log P(text | l) + log P(l) + sum over keys of log P(l | key) - log P(l)``.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pressmill.llm.bytes import byte_rows, gram_codes, sums
from pressmill.llm.common import handing_back, materialize, table

#: Rows that the text models are fitted on, for each declared language, about.
FIT_ROWS = 2000
#: Languages that get a model of their own, the most declared ones; all others share one, named ``POOLED``.
MAX_LANGUAGES = 256
POOLED = "und"
#: Sequences of the whole sample that smooth each language's model: rare ones are like the corpus.
CORPUS_WEIGHT = 200.0
TRACE = 1e-6
#: Keys of one kind up to which their table is broadcast (about 40 bytes each for a language that they have).
BROADCAST_KEYS = 100_000
#: Beyond that the keys of the most rows, so many at most, and rows without a key are dealt over ``SALTS`` parts.
HOT_KEYS = 10_000
SALTS = 64
#: Second labels of countries' registries below which hosts have their domain.
REGISTRY_LABELS = "ac co com edu go gob gouv gov govt gv ltd mil ne net or org plc sch".split()
GRAM_BITS = 16
#: Text counts as at most so many independent bytes.
EVIDENCE_BYTES = 400
#: Rows that smoothing counts the parent distribution as.
SMOOTHING = 8.0
#: Share that smoothing leaves to every language alike.
LEAST = 0.001
MIN_CONFIDENCE = 0.6
#: Share of noise, bytes without order, that every language's text may hold.
NOISE = 0.1
#: Nats a byte by which text is likelier than noise; below this, from so many bytes on, it is
#: no text of any language. Noise alone reaches log(NOISE), -2.3.
MIN_GAIN = -1.0
MIN_GAIN_BYTES = 20


def evidence(docs: DataFrame, id_col: str, text: Column, declared: Column, suffix: Column, host: Column, kind: str = "") -> DataFrame:
    """``(kind, id, text, declared, suffix, host, domain)`` in the form that identification takes.

    Languages are cut to their primary tag and lower case (``de-AT`` is ``de``); blanks are
    null; a host's domain is its last two labels, or three below a country's registry (``example.co.uk``).
    """

    def blank(c: Column) -> Column:
        c = F.lower(F.trim(c.cast("string")))
        return F.when(c != "", c)

    host = blank(host)
    registry = rf"([^.]+\.)(?:{'|'.join(REGISTRY_LABELS)})\.[a-z]{{2}}$"
    domain = F.when(host.rlike(registry), F.regexp_extract(host, registry, 0)).otherwise(F.regexp_extract(host, r"([^.]+\.)?[^.]+$", 0))
    return docs.select(
        F.lit(kind).alias("kind"),
        F.col(id_col).cast("long").alias("id"),
        text.cast("binary").alias("text"),
        F.regexp_extract(blank(declared), "^[a-z]+", 0).alias("declared"),
        blank(suffix).alias("suffix"),
        host.alias("host"),
        domain.alias("domain"),
    ).withColumn("declared", F.when(F.col("declared") != "", F.col("declared")))


KEYS = ("declared", "suffix", "domain", "host")
_ROW = "kind string, id long, declared string, suffix string, host string, domain string"
_SHARES = pa.struct([("k", pa.int32()), ("p", pa.float64())])


def fit(rows: DataFrame, fit_rows: int = FIT_ROWS) -> tuple[list[str], np.ndarray]:
    """Languages and their log-probabilities of the hashed sequences.

    Every declared language is modelled, beyond ``MAX_LANGUAGES`` the less declared ones as one. Fitted on
    a sample of labelled rows, bounded at about ``fit_rows`` for each language and
    drawn by a hash. What is collected is bounded by the languages and ``GRAM_BITS``.
    """
    counts = rows.where(F.col("declared").isNotNull()).groupBy("declared").count()
    top = counts.orderBy(F.desc("count"), "declared").limit(MAX_LANGUAGES)
    sizes = {r["declared"]: r["count"] for r in top.collect()}
    rest = counts.where(~F.col("declared").isin(list(sizes))).agg(F.sum("count")).first()[0] if len(sizes) == MAX_LANGUAGES else None
    if rest:
        sizes[POOLED] = sizes.get(POOLED, 0) + rest
    langs = sorted(sizes)
    if not langs:
        return [], np.zeros((0, 1 << GRAM_BITS), np.float32)
    known = F.when(F.col("declared").isin(langs), F.col("declared")).otherwise(POOLED)
    share = F.create_map(*[F.lit(x) for k in langs for x in (k, min(1.0, fit_rows / sizes[k]))])
    draw = F.pmod(F.xxhash64("kind", "id", F.octet_length("text"), F.lit("langid")), F.lit(1 << 20)) / float(1 << 20)
    sample = rows.where(F.col("declared").isNotNull()).withColumn("declared", known).where(draw < F.element_at(share, F.col("declared")))
    place = {lang: k for k, lang in enumerate(langs)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for b in batches:
            which = b.column("declared").to_pylist()
            for data, starts, rows_ in byte_rows(b.column("text")):
                codes = gram_codes(data, GRAM_BITS, starts)
                for k, row in enumerate(rows_):
                    own = total.setdefault(place[which[row]], np.zeros(1 << GRAM_BITS, np.int64))
                    own += np.bincount(codes[starts[k] : starts[k + 1]], minlength=1 << GRAM_BITS)
        for lang, own in total.items():
            code = np.nonzero(own)[0]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(code), lang)), pa.array(code), pa.array(own[code])], ["lang", "code", "n"])

    found = sample.select("declared", "text").mapInArrow(run, "lang long, code long, n long")
    found = found.groupBy("lang", "code").agg(F.sum("n").alias("n")).toArrow()
    total = np.zeros((len(langs), 1 << GRAM_BITS))
    total[found["lang"].to_numpy(), found["code"].to_numpy()] = found["n"].to_numpy()
    corpus = total.sum(axis=0) / max(1.0, total.sum())
    seen = (total + CORPUS_WEIGHT * corpus) / (total.sum(axis=1, keepdims=True) + CORPUS_WEIGHT)
    return langs, np.log((1 - NOISE) * seen + NOISE / (1 << GRAM_BITS)).astype(np.float32)


def _softmax(logs: np.ndarray) -> np.ndarray:
    parts = np.exp(logs - logs.max(axis=1, keepdims=True))
    return parts / parts.sum(axis=1, keepdims=True)


def _weighted(ll: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Sequences overlap fourfold, and long texts are no more certain than ``EVIDENCE_BYTES``."""
    return ll * np.minimum(0.25, 0.25 * EVIDENCE_BYTES / np.maximum(size, 1))[:, None]


def _sparse(p: np.ndarray) -> pa.Array:
    row, k = np.nonzero(p >= TRACE)
    at = np.searchsorted(row, np.arange(len(p) + 1)).astype(np.int32)
    items = pa.StructArray.from_arrays([pa.array(k, pa.int32()), pa.array(p[row, k])], fields=list(_SHARES))
    return pa.ListArray.from_arrays(pa.array(at), items)


def _dense(shares: pa.Array, width: int) -> np.ndarray:
    """Of lists of ``(k, p)``; a null list is all zeros."""
    out = np.zeros((len(shares), width))
    size = pc.fill_null(pc.list_value_length(shares), 0).to_numpy(zero_copy_only=False)
    items = shares.flatten()
    out[np.repeat(np.arange(len(shares)), size), items.field("k").to_numpy(zero_copy_only=False)] = items.field("p").to_numpy(zero_copy_only=False)
    return out


def text_likelihoods(rows: DataFrame, models: np.ndarray) -> DataFrame:
    """Adds ``size`` (bytes), ``ll`` (one sum of log-probabilities for each language) and ``shares``, the posteriors.

    Texts of no bytes do not testify: their ``shares`` are empty.
    """
    sent = rows.sparkSession.sparkContext.broadcast(models)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        models = sent.value
        for b in batches:
            ll, size = np.zeros((b.num_rows, len(models))), np.zeros(b.num_rows, np.int64)
            for data, starts, rows_ in byte_rows(b.column("text")):
                codes = gram_codes(data, GRAM_BITS, starts)
                size[rows_] += np.diff(starts)
                for k, model in enumerate(models):
                    ll[rows_, k] += sums(model[codes], starts)
            p = np.where(size[:, None] > 0, _softmax(_weighted(ll, size)), 0)
            keys = [b.column(c) for c in ("kind", "id", "declared", "suffix", "host", "domain")]
            flat = pa.ListArray.from_arrays(pa.array(np.arange(b.num_rows + 1) * len(models), pa.int32()), pa.array(ll.ravel()))
            yield pa.RecordBatch.from_arrays([*keys, pa.array(size), flat, _sparse(p)], ["kind", "id", "declared", "suffix", "host", "domain", "size", "ll", "shares"])

    return rows.mapInArrow(handing_back(run), f"{_ROW}, size long, ll array<double>, shares array<struct<k: int, p: double>>")


def _with_sums(rows: DataFrame, sums_: DataFrame, key: str, total: int) -> DataFrame:
    """Adds ``<key>_sums`` of each row's key, or null. Neither a hot key nor rows without one meet in one task."""
    own = sums_.where(F.col("kind") == key).select(F.col("value").alias(key), "n", F.col("sums").alias(f"{key}_sums"))
    if own.count() <= BROADCAST_KEYS:
        return rows.join(F.broadcast(own.drop("n")), key, "left")
    hot = own.where(F.col("n") >= total / HOT_KEYS).select(key, F.lit(True).alias("_hot"))  # HOT_KEYS at most
    salt = F.pmod(F.xxhash64("id", F.octet_length(F.coalesce(key, F.lit(""))), "size"), F.lit(SALTS))
    rows = rows.join(F.broadcast(hot), key, "left").withColumn("_salt", F.when(F.col("_hot") | F.col(key).isNull(), salt).otherwise(0)).drop("_hot")
    own = own.withColumn("_salt", F.explode(F.when(F.col("n") >= total / HOT_KEYS, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))))
    return rows.join(own.withColumn("_salt", F.col("_salt").cast("long")).drop("n"), [key, "_salt"], "left").drop("_salt")


def fuse(
    ll: np.ndarray, size: np.ndarray, own: np.ndarray, prior: np.ndarray, sums_: dict[str, np.ndarray]
) -> np.ndarray:
    """Posteriors of rows, a language a column, from their likelihoods, own shares, and the sums of their keys."""

    def smoothed(key: str, parent: np.ndarray) -> np.ndarray:
        """P(language | key) without the row's own share; the parent's where there is no key."""
        counts = np.maximum(sums_[key] - own, 0)
        return (counts + SMOOTHING * parent) / (counts.sum(axis=1, keepdims=True) + SMOOTHING)

    base = np.broadcast_to(prior, ll.shape)
    log = _weighted(ll, size) + np.log(base)
    for share in (smoothed("declared", base), smoothed("suffix", base), smoothed("host", smoothed("domain", base))):
        log = log + np.log(share * (1 - LEAST) + LEAST / len(prior)) - np.log(base)
    return _softmax(log)


def identify(rows: DataFrame, fit_rows: int = FIT_ROWS) -> DataFrame:
    """``(kind, id, lang, confidence, gain, accepted)`` for rows as ``evidence`` gives them.

    ``accepted`` is false if no language reaches ``MIN_CONFIDENCE`` or the text is not
    ``MIN_GAIN`` nats a byte likelier than noise in its language. ``lang`` is ``POOLED`` for languages beyond the
    ``MAX_LANGUAGES`` most declared ones. Null and empty texts are
    judged by their other evidence; with none at all every row gets the corpus prior's
    language. Repeated rows and ids are kept; other columns are ignored. If no row declares a language,
    ``lang`` is null and every row is accepted. An empty table gives an empty result.
    """
    langs, models = fit(rows, fit_rows)
    if not langs:
        none = F.lit(None).cast("double")
        return rows.select("kind", "id", F.lit(None).cast("string").alias("lang"), none.alias("confidence"), none.alias("gain"), F.lit(True).alias("accepted"))
    scored = materialize(text_likelihoods(rows, models), "langid")

    # one pass for the sums of all keys, and of the whole corpus as the key null
    keyed = scored.select(F.explode(F.array(F.struct(F.lit("corpus").alias("kind"), F.lit("").alias("value")), *[F.struct(F.lit(k).alias("kind"), F.col(k).alias("value")) for k in KEYS])).alias("key"), "shares")
    keyed = keyed.where("key.value is not null").select("key.*", F.explode("shares").alias("s")).groupBy("kind", "value", "s.k").agg(F.sum("s.p").alias("p"))
    found = keyed.groupBy("kind", "value").agg(F.sum("p").alias("n"), F.collect_list(F.struct("k", "p")).alias("sums"))  # a list of the languages
    found = materialize(found, "keys")
    prior, total = np.zeros(len(langs)), 0.0
    for r in found.where("kind = 'corpus'").collect():
        total = r["n"]
        for s in r["sums"]:
            prior[s["k"]] = s["p"]
    prior = (prior + 1.0) / (total + len(langs))

    out = scored
    for key in KEYS:
        out = _with_sums(out, found, key, max(1.0, total))
    schema = "kind string, id long, lang string, confidence double, gain double, accepted boolean"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = pa.array(langs)
        for b in batches:
            size = b.column("size").to_numpy(zero_copy_only=False)
            ll = b.column("ll").flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, len(langs))
            post = fuse(ll, size, _dense(b.column("shares"), len(langs)), prior, {k: _dense(b.column(f"{k}_sums"), len(langs)) for k in KEYS})
            best = post.argmax(axis=1)
            sure = post[np.arange(len(best)), best]
            gain = ll[np.arange(len(best)), best] / np.maximum(size, 1) + GRAM_BITS * math.log(2)
            noise = (size >= MIN_GAIN_BYTES) & (gain < MIN_GAIN)
            ok = (sure >= MIN_CONFIDENCE) & ~noise
            yield pa.RecordBatch.from_arrays(
                [b.column("kind"), b.column("id"), names.take(pa.array(best)), pa.array(sure), pa.array(gain), pa.array(ok)],
                ["kind", "id", "lang", "confidence", "gain", "accepted"],
            )

    fields = ["kind", "id", "size", "ll", "shares", *(f"{k}_sums" for k in KEYS)]
    return materialize(out.select(*fields).mapInArrow(run, schema), "languages")


def document_evidence(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Documents name their language and, as host, their source; they have no address."""
    none = F.lit(None).cast("string")
    return evidence(docs, id_col, F.col("text"), F.col("lang"), none, F.col("source"), "document")


def page_evidence(pages: DataFrame) -> DataFrame:
    """Pages: the markup's ``lang``, the address's last label and two-letter path head, the host."""
    html = F.col("html").cast("string")
    text = F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->|<[^>]*>", " ")
    url = F.lower(F.col("url").cast("string"))
    host = F.regexp_extract(url, r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)
    head = F.regexp_extract(url, r"^[a-z][a-z0-9+.-]*://[^/?#]*/([a-z]{2})(?:[/?#-]|$)", 1)
    suffix = F.concat_ws("/", F.regexp_extract(host, r"([^.]+)$", 1), head)
    return evidence(pages, "page_id", text, F.regexp_extract(html, r"(?is)<html\b[^>]*?\blang\s*=\s*[\"']?([a-z]+)", 1), suffix, host, "page")


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and pages in one identification; ids of the two kinds in columns of their own."""
    docs = document_evidence(table(spark, sf_dir, "documents"))
    out = identify(docs.unionByName(page_evidence(table(spark, sf_dir, "pages"))))
    return out.select(
        F.when(F.col("kind") == "document", F.col("id")).alias("doc_id"), F.when(F.col("kind") == "page", F.col("id")).alias("page_id"),
        "lang", F.round("confidence", 6).alias("confidence"), "accepted",
    )
