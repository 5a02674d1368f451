"""Token ids in wavelet matrices, one compressed file for each shard.

A file holds the ids of consecutive documents as bit planes from the highest bit down; each
plane is stably partitioned by the one above. With the counts of ones (rank) it answers
access, counting and occurrence lookup without another copy of the ids:

    magic ``WVMX2\n`` | header length, 4 bytes | JSON header | sections, each a zstd frame

Sections are the document ids and lengths (little-endian 64-bit), then the planes, each in chunks of
``CHUNK_BITS`` packed bits. The header names the sections' lengths, the token count, the bits, the zeros of
each plane, and the rank directory: the ones of each plane before each of its chunks. A reader fetches
the header, and of the planes only the chunks that a question touches.
"""

from __future__ import annotations

import io
import json
import os
import uuid
import zlib
from collections.abc import Iterator
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pressmill.llm.common import materialize, offsets, shared_dir, table
from pressmill.llm.tokens import vocabulary_path

WORD_BPE = "word_bpe_49k.json"
END_ID = 2
#: Tokens of a shard; the document that reaches it is the shard's last.
SHARD_TOKENS = 2_000_000
#: Files that one task reads, about.
FILES_A_TASK = 4
#: Text that is encoded at once, and words a worker remembers.
PIECE_BYTES = 8_000_000
CACHED_WORDS = 1_500_000
MAGIC = b"WVMX2\n"
#: Bits of a plane that are compressed together.
CHUNK_BITS = 1 << 18


# ---------------------------------------------------------------- encoding


#: What a tokenizer must do to be asked word by word: fold case, and split into letters, single digits and runs
#: of marks, white space dropped. Its file's settings.
WORDWISE = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pattern": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+",
}


class WordEncoder:
    """Encodes texts, word by word where the tokenizer's words never reach across spaces or line ends.

    Such a tokenizer (``WORDWISE``) drops white space and works word by word, so a text's ids are those of its
    space-separated parts in a row. Each distinct part is encoded by the tokenizer once and
    remembered, up to ``CACHED_WORDS``; texts are then put together in bulk. Any other tokenizer gets whole texts.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        own = json.loads(self.tokenizer.to_str())
        split = ((own.get("pre_tokenizer") or {}).get("pretokenizers") or [{}])[0]
        self.wordwise = (
            own.get("normalizer") == WORDWISE["normalizer"] and split.get("pattern") == {"Regex": WORDWISE["pattern"]}
            and split.get("behavior") == "Removed" and split.get("invert") is True
        )
        self._clear()

    def _clear(self) -> None:
        self.words = pa.array([], pa.large_string())
        self.ids, self.starts, self.lengths = np.empty(0, np.uint32), np.empty(0, np.int64), np.empty(0, np.int32)

    def _learn(self, words: pa.Array) -> None:
        found = [e.ids for e in self.tokenizer.encode_batch_fast(words.to_pylist(), add_special_tokens=False)]
        n = np.fromiter(map(len, found), np.int32, len(found))
        flat = np.fromiter(chain.from_iterable(found), np.uint32, int(n.sum()))
        self.words = pa.concat_arrays([self.words, words])
        self.starts = np.concatenate((self.starts, np.cumsum(n, dtype=np.int64) - n + len(self.ids)))
        self.ids, self.lengths = np.concatenate((self.ids, flat)), np.concatenate((self.lengths, n))

    @staticmethod
    def _simpler(texts: pa.Array) -> pa.Array:
        """Texts with the same ids and fewer distinct parts: lower case, and marks that end a word apart.

        The tokenizer folds case itself and parts letters from marks. Texts that may hold special
        tokens, which it finds as they are written, stay as they are.
        """
        lower = pc.replace_substring_regex(pc.ascii_lower(texts), r"([a-z])([,.])( |$)", r"\1 \2\3")
        return pc.if_else(pc.match_substring(texts, "<|"), texts, lower)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids in a row, and the number of each text; null counts as empty."""
        if not self.wordwise:
            found = [e.ids for e in self.tokenizer.encode_batch_fast([t or "" for t in texts.to_pylist()], add_special_tokens=False)]
            n = np.fromiter(map(len, found), np.int64, len(found))
            return np.fromiter(chain.from_iterable(found), np.uint32, int(n.sum())), n
        # first a step that copies: lower-casing a slice of an array in place is not sound
        texts = pc.replace_substring(pc.fill_null(texts.cast(pa.large_string()), ""), "\n", " ")
        parts = pc.split_pattern(self._simpler(texts), " ")
        words = parts.flatten().dictionary_encode()
        distinct = words.dictionary.cast(pa.large_string())
        if len(self.words) > CACHED_WORDS:
            self._clear()
        known = pc.index_in(distinct, value_set=self.words)
        if known.null_count:
            before = len(self.words)
            self._learn(distinct.filter(known.is_null()))
            known = known.to_numpy(zero_copy_only=False)
            new = np.isnan(known)
            known[new] = np.arange(before, len(self.words))
        else:
            known = known.to_numpy(zero_copy_only=False)
        known, codes = known.astype(np.int64), words.indices.to_numpy(zero_copy_only=False)
        lengths = self.lengths[known][codes]
        ends = np.cumsum(lengths, dtype=np.int64)
        total = int(ends[-1]) if len(ends) else 0
        at = np.repeat(self.starts[known][codes] - (ends - lengths), lengths)
        at += np.arange(total)
        bounds = np.concatenate(([0], ends))[parts.offsets.to_numpy() - parts.offsets[0].as_py()]
        return self.ids[at], np.diff(bounds)


@cache
def word_encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


def pieces(batch: pa.RecordBatch, column: int) -> Iterator[pa.RecordBatch]:
    """Slices of at most about ``PIECE_BYTES`` of text, of one row at least."""
    size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    ends, at = np.cumsum(size, dtype=np.int64), 0
    while at < len(size):
        done = int(ends[at - 1]) if at else 0
        to = max(at + 1, int(np.searchsorted(ends, done + PIECE_BYTES, "right")))
        yield batch.slice(at, to - at)
        at = to


# ---------------------------------------------------------------- the file


def build(ids: np.ndarray, doc_ids: np.ndarray, lengths: np.ndarray, nulls: int = 0, level: int = 1) -> bytes:
    """The file's bytes for the ids of some documents in a row, the first ``nulls`` of them without an id."""
    bits = max(1, int(ids.max()).bit_length()) if len(ids) else 1
    cur = ids.astype(np.uint16 if bits <= 16 else np.uint32)
    press = zstandard.ZstdCompressor(level=level).compress
    sections, zeros, ranks = [press(doc_ids.astype("<i8").tobytes()), press(lengths.astype("<i8").tobytes())], [], []
    for b in range(bits - 1, -1, -1):
        ones = (cur & cur.dtype.type(1 << b)).astype(bool)
        packed = np.packbits(ones, bitorder="little")
        chunks = [packed[at : at + CHUNK_BITS // 8] for at in range(0, len(packed), CHUNK_BITS // 8)]
        sections += [press(c.tobytes()) for c in chunks]
        ranks.append([0, *np.cumsum([int(np.bitwise_count(c).sum()) for c in chunks]).tolist()])
        low = cur[~ones]
        zeros.append(len(low))
        cur = np.concatenate((low, cur[ones]))
    head = {
        "tokens": len(ids), "docs": len(doc_ids), "nulls": nulls, "bits": bits, "chunk": CHUNK_BITS, "zeros": zeros,
        "ranks": ranks, "sections": [len(s) for s in sections],
    }
    head = json.dumps(head).encode()
    return b"".join((MAGIC, len(head).to_bytes(4, "little"), head, *sections))


class WaveletFile:
    """Reads one file, given as bytes or as an open file that can seek: ``access``, ``count``, ``locate``, ``decode``."""

    def __init__(self, source):
        self._file = f = io.BytesIO(source) if isinstance(source, (bytes, bytearray)) else source
        if f.read(len(MAGIC)) != MAGIC:
            raise ValueError("not a wavelet matrix file")
        head = json.loads(f.read(int.from_bytes(f.read(4), "little")))
        self.tokens, self.bits, self.zeros, self.chunk_bits, self.nulls = (head[k] for k in ("tokens", "bits", "zeros", "chunk", "nulls"))
        self.ranks = [np.array(r, np.int64) for r in head["ranks"]]
        self._sizes = head["sections"]
        self._starts = (np.cumsum([0, *self._sizes]) + f.tell()).tolist()
        self._chunks: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}

    def _section(self, n: int) -> bytes:
        self._file.seek(self._starts[n])
        return zstandard.ZstdDecompressor().decompress(self._file.read(self._sizes[n]))

    @property
    def doc_ids(self) -> np.ndarray:
        return np.frombuffer(self._section(0), "<i8")

    @property
    def lengths(self) -> np.ndarray:
        return np.frombuffer(self._section(1), "<i8")

    def _bytes(self, plane: int, chunk: int) -> np.ndarray:
        return np.frombuffer(self._section(2 + plane * (len(self.ranks[0]) - 1) + chunk), np.uint8)

    def _chunk(self, plane: int, chunk: int) -> tuple[np.ndarray, np.ndarray]:
        """A chunk's bytes, and the ones of the plane before each of them and at the end."""
        key = (plane, chunk)
        if key not in self._chunks:
            data = self._bytes(plane, chunk)
            ones = np.concatenate(([0], np.cumsum(np.bitwise_count(data), dtype=np.uint32))) + self.ranks[plane][chunk]
            self._chunks[key] = (np.append(data, np.uint8(0)), ones)
        return self._chunks[key]

    def _rank(self, plane: int, at: np.ndarray | int) -> np.ndarray:
        """Ones of a plane before ``at``: the directory's count, and the rest from the one chunk."""
        at = np.atleast_1d(np.asarray(at, np.int64))
        out = np.empty(at.shape, np.int64)
        last = len(self.ranks[plane]) - 2
        which = np.minimum(at // self.chunk_bits, max(last, 0))
        for c in np.unique(which) if last >= 0 else ():
            mine = which == c
            data, ones = self._chunk(plane, int(c))
            own = at[mine] - c * self.chunk_bits
            out[mine] = ones[own >> 3] + np.bitwise_count(data[own >> 3] & ((1 << (own & 7)) - 1).astype(np.uint8))
        if last < 0:
            out[:] = 0
        return out

    def access(self, at: np.ndarray | int) -> np.ndarray:
        """The ids at these positions."""
        at = np.atleast_1d(np.asarray(at, np.int64))
        value = np.zeros(at.shape, np.uint32)
        for k, zeros in enumerate(self.zeros):
            ones = self._rank(k, at)
            bit = self._rank(k, at + 1) - ones
            value = (value << 1) | bit.astype(np.uint32)
            at = np.where(bit == 1, zeros + ones, at - ones)
        return value

    def _span(self, token: int, start: int, end: int) -> tuple[int, int]:
        for k, zeros in enumerate(self.zeros):
            a, b = (int(x) for x in self._rank(k, np.array([start, end])))
            if token >> (self.bits - 1 - k) & 1:
                start, end = zeros + a, zeros + b
            else:
                start, end = start - a, end - b
        return start, end

    def count(self, token: int, start: int = 0, end: int | None = None) -> int:
        """Occurrences of a token among the positions from ``start`` to before ``end``."""
        if token < 0 or token >> self.bits:
            return 0
        a, b = self._span(token, start, self.tokens if end is None else end)
        return b - a

    def _select(self, plane: int, bit: int, nth: np.ndarray) -> np.ndarray:
        """The positions of the nth (from 0) set or clear bits of a plane, the chunks found in the directory."""
        ranks = self.ranks[plane]
        ends = np.minimum(np.arange(len(ranks)) * self.chunk_bits, self.tokens)
        have = ranks if bit else ends - ranks
        which = np.searchsorted(have, nth, "right") - 1
        out = np.empty(nth.shape, np.int64)
        for c in np.unique(which):
            mine = which == c
            size = int(ends[c + 1] - ends[c])
            own = np.unpackbits(self._chunk(plane, int(c))[0], count=size, bitorder="little")
            out[mine] = ends[c] + np.flatnonzero(own == bit)[nth[mine] - have[c]]
        return out

    def _up(self, token: int, at: np.ndarray) -> np.ndarray:
        for k in range(self.bits - 1, -1, -1):
            bit = token >> (self.bits - 1 - k) & 1
            at = self._select(k, bit, at - self.zeros[k] if bit else at)
        return at

    def locate(self, token: int, nth: int) -> int | None:
        """The position of the nth (from 0) occurrence of a token."""
        if not 0 <= nth < self.count(token):
            return None
        return int(self._up(token, np.array([self._span(token, 0, self.tokens)[0] + nth]))[0])

    def occurrences(self, token: int) -> np.ndarray:
        """The positions of all occurrences of a token, in order."""
        if token < 0 or token >> self.bits:
            return np.empty(0, np.int64)
        return self._up(token, np.arange(*self._span(token, 0, self.tokens)))

    def decode(self) -> np.ndarray:
        """All ids in order: the planes undone from the lowest bit up."""
        kind = np.uint16 if self.bits <= 16 else np.uint32
        cur = np.zeros(self.tokens, kind)
        for k in range(self.bits - 1, -1, -1):
            plane = [self._bytes(k, c) for c in range(len(self.ranks[k]) - 1)]
            ones = np.unpackbits(np.concatenate(plane) if plane else np.empty(0, np.uint8), count=self.tokens, bitorder="little").view(bool)
            up, zeros = np.empty_like(cur), self.zeros[k]
            up[~ones] = cur[:zeros]
            up[ones] = cur[zeros:] | kind(1 << (self.bits - 1 - k))
            cur = up
        return cur


# ---------------------------------------------------------------- Spark


def write_shards(
    docs: DataFrame, folder: str, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = WORD_BPE,
    end_id: int = END_ID, shard_tokens: int = SHARD_TOKENS,
) -> DataFrame:
    """Writes the files and returns their manifest ``(part, shard, path, docs, tokens, start)``.

    Documents are dealt by ranges of their id and sorted, so files in order of part and shard
    hold them in ascending id; equal ids are ordered by a hash of the text, and rows alike in both are
    shared out too. ``start`` is the number of ids in all files before. Other columns are ignored. A task that runs again writes files of new names, and
    only those of the attempt that counted are in the manifest. Null and empty texts hold
    just ``end_id``; rows with a null id come first; an empty table gives no files.
    """
    path = vocabulary if "/" in vocabulary else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, shard = TaskContext.get().partitionId(), 0
        encoder = word_encoder(path or vocabulary_path(vocabulary))
        fs, base = pyarrow.fs.FileSystem.from_uri(folder)
        ids: list[np.ndarray] = []
        names: list[pa.Array] = []
        lengths: list[np.ndarray] = []

        def flush() -> pa.RecordBatch:
            n = np.concatenate(lengths)
            all_ids = np.concatenate(ids)
            name = f"{base}/{part:06d}-{shard:06d}-{uuid.uuid4().hex}.wvm"
            with fs.open_output_stream(name) as out:
                own = pa.concat_arrays(names)  # null ids come first
                out.write(build(all_ids, pc.fill_null(own, 0).to_numpy(), n, own.null_count))
            row = {"part": [part], "shard": [shard], "path": [f"{folder}/{name.rsplit('/', 1)[1]}"], "docs": [len(n)], "tokens": [len(all_ids)]}
            for x in (ids, names, lengths):
                x.clear()
            return pa.RecordBatch.from_pydict(row, pa.schema([("part", pa.int32()), ("shard", pa.int32()), ("path", pa.string()), ("docs", pa.int64()), ("tokens", pa.int64())]))

        held = 0
        for batch in batches:
            for piece in pieces(batch, 1):
                got, n = encoder.encode(piece.column(1))
                got = np.insert(got, np.cumsum(n), end_id).astype(np.uint32)
                n, own = n + 1, piece.column(0)
                ends, at = np.cumsum(n), 0
                while at < len(n):
                    done = int(ends[at - 1]) if at else 0
                    to = min(len(n), int(np.searchsorted(ends, done + shard_tokens - held)) + 1)
                    ids.append(got[done : ends[to - 1]]), names.append(own.slice(at, to - at)), lengths.append(n[at:to])
                    held += int(ends[to - 1]) - done
                    at = to
                    if held >= shard_tokens:
                        yield flush()
                        held, shard = 0, shard + 1
        if lengths:
            yield flush()

    rows = docs.select(
        F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("t"), F.xxhash64(text_col).alias("h"),
        F.xxhash64(F.monotonically_increasing_id()).alias("r"),
    )
    rows = rows.repartitionByRange("id", "h", "r").sortWithinPartitions("id", "h", "r").select("id", "t")
    shards = rows.mapInArrow(run, "part int, shard int, path string, docs long, tokens long")
    shards = materialize(shards, "manifest")
    parts = offsets(shards.groupBy("part").agg(F.sum("tokens").alias("n")), ["part"], "n", "before")
    own = Window.partitionBy("part").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    shards = shards.join(parts.select("part", "before"), "part")
    return shards.select(
        "part", "shard", "path", "docs", "tokens",
        (F.col("before") + F.coalesce(F.sum("tokens").over(own), F.lit(0))).alias("start"),
    )


def read_shards(manifest: DataFrame) -> DataFrame:
    """``(id, start, n_tokens, ids_crc32)`` of every document, decoded from the files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, start in zip(batch.column("path").to_pylist(), batch.column("start").to_pylist(), strict=True):
                fs, name = pyarrow.fs.FileSystem.from_uri(path)
                with fs.open_input_stream(name) as f:
                    shard = WaveletFile(f.read())
                ids, doc_ids, lengths = shard.decode().astype("<u4"), shard.doc_ids, shard.lengths
                ends = np.cumsum(lengths)
                data, at = memoryview(ids.view(np.uint8)), (np.concatenate(([0], ends)) * 4).tolist()
                crc = [zlib.crc32(data[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)]
                own = pa.array(doc_ids, mask=np.arange(len(doc_ids)) < shard.nulls)
                yield pa.RecordBatch.from_arrays(
                    [own, pa.array(start + ends - lengths), pa.array(lengths), pa.array(crc, pa.int64())],
                    ["id", "start", "n_tokens", "ids_crc32"],
                )

    return _file_tasks(manifest).mapInArrow(run, "id long, start long, n_tokens long, ids_crc32 long")


def _file_tasks(manifest: DataFrame) -> DataFrame:
    """One task for each few files; without a number the tiny manifest would be read in one."""
    return manifest.select("path", "start").repartition(max(1, -(-manifest.count() // FILES_A_TASK)), "path")


def count_tokens(manifest: DataFrame, tokens: list[int]) -> DataFrame:
    """``(token, start, n)``: how often each token occurs in each file, by rank alone; one chunk of each plane or two are read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, start in zip(batch.column("path").to_pylist(), batch.column("start").to_pylist(), strict=True):
                fs, name = pyarrow.fs.FileSystem.from_uri(path)
                with fs.open_input_file(name) as f:
                    shard = WaveletFile(f)
                    n = [shard.count(t) for t in tokens]
                yield pa.RecordBatch.from_arrays([pa.array(tokens, pa.int64()), pa.array([start] * len(n), pa.int64()), pa.array(n, pa.int64())], ["token", "start", "n"])

    return _file_tasks(manifest).mapInArrow(run, "token long, start long, n long")


def locate_token(manifest: DataFrame, token: int) -> DataFrame:
    """``(id, at, offset)``: every occurrence, its place among all ids and in its document, by select."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, start in zip(batch.column("path").to_pylist(), batch.column("start").to_pylist(), strict=True):
                fs, name = pyarrow.fs.FileSystem.from_uri(path)
                with fs.open_input_file(name) as f:
                    shard = WaveletFile(f)
                    found = shard.occurrences(token)
                    doc_ids, ends = shard.doc_ids, np.cumsum(shard.lengths)
                    doc = np.searchsorted(ends, found, "right")
                    offset = found - (ends - shard.lengths)[doc]
                    own = pa.array(doc_ids[doc], mask=doc < shard.nulls)
                yield pa.RecordBatch.from_arrays([own, pa.array(start + found), pa.array(offset)], ["id", "at", "offset"])

    return _file_tasks(manifest).mapInArrow(run, "id long, at long, offset long")


def op6_wavelet(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{shared_dir(spark)}/pressmill/wavelet-{uuid.uuid4().hex}"
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(hadoop)
    manifest = write_shards(table(spark, sf_dir, "documents"), folder)
    return read_shards(manifest).withColumnRenamed("id", "doc_id")
