import random

import numpy as np

from pressmill.llm import bytes as textbytes
from pressmill.llm import quality
from tests.llm.util import documents, odd_texts, words

LABELS = "doc_id long, quality int, toxic int, score double"


def corpus():
    rng = random.Random(15)
    rows, labels = [], []
    for k in range(900):
        good = rng.random() < 0.7
        w = words(rng, rng.randrange(20, 120))
        if not good:
            kind = rng.randrange(3)
            w = [w[0]] * len(w) if kind == 0 else [x + rng.choice(["$$$", "%%%"]) for x in w] if kind == 1 else [x.upper() + "!!" for x in w]
        source = rng.choice(["src0", "src1", "src2", "src3"] if good else ["src3", "src4", "src5", "src6"])  # the metadata view knows only these
        rows.append((k, " ".join(w), "en", source))
        labels.append((k, int(good), 0, 0.5))
    return rows, labels


def test_held_out_accuracy_and_odd_rows(spark):
    rows, labels = corpus()
    odd = [(2000 + k, t) for k, t in enumerate(odd_texts(random.Random(16)))]
    known = [*[x for x in labels if x[0] % 3], (5, None, None, None), (None, 1, 0, 0.1), (77777, 1, 0, 0.1)]
    got = quality.classify(documents(spark, [*rows, *odd, rows[0], (None, None)]), spark.createDataFrame(known, LABELS)).collect()
    assert len(got) == len(rows) + len(odd) + 2
    by = {r["id"]: r for r in got}
    unseen = [x for x in labels if x[0] % 3 == 0]
    right = sum(by[i]["accepted"] == bool(q) for i, q, *_ in unseen) / len(unseen)
    lost = sum(not by[i]["accepted"] for i, q, *_ in unseen if q)
    assert right > 0.95 and lost <= 0.03 * len(unseen)
    assert all(0 <= r[c] <= 1 for r in got for c in ("text_score", "meta_score", "score"))


def test_views_teach_each_other(spark):
    rows, labels = corpus()
    model = quality.train(quality.feature_rows(documents(spark, rows)), spark.createDataFrame([x for x in labels if x[0] % 4 == 0], LABELS))
    assert sum(a for a, _ in model.exchanged) and sum(b for _, b in model.exchanged)
    assert model.held_out["both"] >= max(model.held_out["text"], model.held_out["metadata"]) - 0.02


def test_one_class_or_no_labels_accepts_all(spark):
    docs = documents(spark, [(1, "a b"), (2, None)])
    for labels in ([], [(1, 1, 0, 0.0)]):
        got = quality.classify(docs, spark.createDataFrame(labels, LABELS)).collect()
        assert sorted((r["id"], r["score"], r["accepted"]) for r in got) == [(1, None, True), (2, None, True)]
    assert quality.classify(documents(spark, []), spark.createDataFrame([], LABELS)).collect() == []


def test_calibration_gives_probabilities():
    rng = np.random.default_rng(17)
    z = rng.normal(0, 3, 4000)
    y = (rng.random(4000) < 1 / (1 + np.exp(-(0.5 * z - 1)))).astype(float)
    slope, offset = quality.calibration(z, y)
    assert abs(slope - 0.5) < 0.06 and abs(offset + 1) < 0.15
    apart = quality.calibration(np.r_[np.full(50, -9.0), np.full(50, 9.0)], np.r_[np.zeros(50), np.ones(50)])
    assert 0 < apart[0] < 2 and abs(apart[1]) < 1


def test_bytes_come_once_each(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(textbytes, "PIECE", 10)
    texts = [b"", None, b"abc", b"x" * 25, b"12345", b"", b"67890A", None]
    for at in (0, 2):
        part = texts[at:]
        got = [b""] * len(part)
        for data, starts, rows in textbytes.byte_rows(pa.array(texts, pa.binary()).slice(at)):
            for k, r in enumerate(rows):
                got[r] += data[starts[k] : starts[k + 1]].tobytes()
        assert got == [t or b"" for t in part]
    a, b = (textbytes.gram_codes(np.frombuffer(t, np.uint8), 16, np.array([0, 4])) for t in (b"HaUs", b"haus"))
    assert a.tolist() == b.tolist()


def test_neighbours_do_not_matter():
    texts = [b"ab", b"haus maus haus maus", b"x", b"haus"]
    data, starts = np.frombuffer(b"".join(texts), np.uint8), np.concatenate(([0], np.cumsum([len(t) for t in texts])))
    codes = textbytes.gram_codes(data, 32, starts)
    again = textbytes.echoes(codes, starts, range(2, 25))
    for k, t in enumerate(texts):
        own = textbytes.gram_codes(np.frombuffer(t, np.uint8), 32, np.array([0, len(t)]))
        assert own.tolist() == codes[starts[k] : starts[k + 1]].tolist()
        slow = sum(own[i] == own[i - lag] for lag in range(2, 25) for i in range(lag, len(own)))
        assert again[k] == slow
