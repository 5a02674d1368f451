import io
import json
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from pressmill.llm import wavelet
from pressmill.llm.tokens import vocabulary_path
from tests.llm.util import documents, odd_texts, words


@pytest.mark.parametrize("chunk", [1 << 18, 64])
@pytest.mark.parametrize("n,top", [(0, 1), (1, 1), (1000, 3), (5000, 49_407), (777, 70_000)])
def test_file_against_plain_array(n, top, chunk, monkeypatch):
    monkeypatch.setattr(wavelet, "CHUNK_BITS", chunk)
    ids = np.random.default_rng(n).integers(0, top + 1, n).astype(np.uint32)
    f = wavelet.WaveletFile(wavelet.build(ids, np.array([5]), np.array([n])))
    assert np.array_equal(f.decode(), ids) and f.doc_ids.tolist() == [5] and f.lengths.tolist() == [n]
    if not n:
        assert f.count(3) == 0 and f.locate(3, 0) is None
        return
    assert np.array_equal(f.access(np.arange(n)), ids)
    for token in {int(ids[0]), int(ids[-1]), 0, top}:
        where = np.nonzero(ids == token)[0]
        assert f.count(token) == len(where)
        assert f.count(token, n // 3, n // 2) == ((where >= n // 3) & (where < n // 2)).sum()
        assert [f.locate(token, k) for k in range(min(5, len(where)))] == where[:5].tolist()
        assert f.occurrences(token).tolist() == where.tolist()
        assert f.locate(token, len(where)) is None and f.locate(token, -1) is None
    assert f.count(1 << 20) == 0 and f.count(-1) == 0


def test_questions_read_few_chunks(monkeypatch):
    monkeypatch.setattr(wavelet, "CHUNK_BITS", 64)
    ids = np.random.default_rng(1).integers(0, 1000, 20_000).astype(np.uint32)
    data = wavelet.build(ids, np.array([5]), np.array([20_000]))
    f = wavelet.WaveletFile(data)
    chunks = sum(len(r) - 1 for r in f.ranks)
    assert f.access(777).tolist() == [ids[777]] and 0 < len(f._chunks) <= 2 * f.bits < chunks / 100
    f = wavelet.WaveletFile(io.BytesIO(data))
    assert f.count(int(ids[5])) == (ids == ids[5]).sum() and len(f._chunks) <= 2 * f.bits


def test_other_tokenizers_get_whole_texts(tmp_path):
    own = json.loads(Tokenizer.from_file(vocabulary_path(wavelet.WORD_BPE)).to_str())
    own["normalizer"] = None  # keeps case and white space
    (tmp_path / "cased.json").write_text(json.dumps(own))
    cased = Tokenizer.from_file(str(tmp_path / "cased.json"))
    encoder = wavelet.WordEncoder(str(tmp_path / "cased.json"))
    texts = ["Ab ab, AB.", None, "x"]
    ids, n = encoder.encode(pa.array(texts))
    want = [cased.encode(t or "", add_special_tokens=False).ids for t in texts]
    assert not encoder.wordwise and ids.tolist() == [x for w in want for x in w] and n.tolist() == [len(w) for w in want]
    assert wavelet.WordEncoder(vocabulary_path(wavelet.WORD_BPE)).wordwise


def plain(text):
    return Tokenizer.from_file(vocabulary_path(wavelet.WORD_BPE)).encode(text or "", add_special_tokens=False).ids


def test_encoder_against_the_tokenizer(monkeypatch):
    monkeypatch.setattr(wavelet, "CACHED_WORDS", 50)
    rng = random.Random(8)
    odd = ["Bare, words. Here,, and. so,. \"A,\" b.\nC., D,", "it's  we'LL\r\nx y z é ́a 12,5%% ...!!", "<|endoftext|>a <|startoftext|>", "a\x1cb\x85c", "ΣΑΣ ΟΔΟΣ"]
    texts = [*odd_texts(rng), *odd, *(" ".join(words(rng, 30)) for _ in range(30))]
    encoder = wavelet.WordEncoder(vocabulary_path(wavelet.WORD_BPE))
    for part in (texts[:5], texts[5:], texts[3:9], [], [None]):
        ids, n = encoder.encode(pa.array(part, pa.string()))
        assert n.tolist() == [len(plain(t)) for t in part]
        assert ids.tolist() == [x for t in part for x in plain(t)]
    ids, n = encoder.encode(pa.array(texts, pa.string()).slice(4, 20))
    assert ids.tolist() == [x for t in texts[4:24] for x in plain(t)] and len(n) == 20


def test_written_and_read_back(spark, tmp_path):
    rng = random.Random(9)
    rows = [(900 - k, t) for k, t in enumerate(odd_texts(rng))] + [(k, " ".join(words(rng, rng.randrange(50)))) for k in range(80)]
    rows += [rows[3], (None, "no id"), (-5, "before all"), (-(1 << 63), "least id")]
    manifest = wavelet.write_shards(documents(spark, rows), f"file://{tmp_path}", shard_tokens=500)
    assert manifest.count() > 3
    got = sorted(wavelet.read_shards(manifest).collect(), key=lambda r: r["start"])
    ids = [[*plain(t), wavelet.END_ID] for _, t in rows]
    want = sorted((i is not None, i or 0, len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for (i, _), x in zip(rows, ids, strict=True))
    assert sorted((r["id"] is not None, r["id"] or 0, r["n_tokens"], r["ids_crc32"]) for r in got) == want
    at = 0
    for r in got:
        assert r["start"] == at
        at += r["n_tokens"]
    own = [r["id"] for r in got]
    assert own[0] is None and own[1:] == sorted(own[1:])
    stream = [x for r in got for x in next(w for (i, _), w in zip(rows, ids, strict=True) if i == r["id"] and len(w) == r["n_tokens"])]
    counts = wavelet.count_tokens(manifest, [wavelet.END_ID, 1 << 20]).groupBy("token").sum("n").collect()
    assert {r["token"]: r["sum(n)"] for r in counts} == {wavelet.END_ID: len(rows), 1 << 20: 0}
    found = sorted((r["at"], r["offset"]) for r in wavelet.locate_token(manifest, wavelet.END_ID).collect())
    assert found == sorted((r["start"] + r["n_tokens"] - 1, r["n_tokens"] - 1) for r in got)
    assert all(stream[at] == wavelet.END_ID for at, _ in found)


def test_empty_table(spark, tmp_path):
    assert wavelet.read_shards(wavelet.write_shards(documents(spark, []), f"file://{tmp_path}")).collect() == []
