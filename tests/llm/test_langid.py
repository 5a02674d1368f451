import math
import random

import pytest

from pressmill.llm import langid
from tests.llm.util import documents, odd_texts

WORDS = {
    "en": "the and of with that from this have been were which their would there about after house river".split(),
    "de": "der die und nicht mit von auch werden haben eine über zwischen straße möchte haus fluss später".split(),
    "fr": "le les des une dans avec pour être était après maison fleuve très français garçon où déjà".split(),
}


def text(rng, lang, n):
    return " ".join(rng.choice(WORDS[lang]) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(14)
    out = [(k, text(rng, lang := rng.choice(list(WORDS)), rng.randrange(8, 60)), lang, f"host-{lang}") for k in range(300)]
    out += [(1000 + k, t, "en", None) for k, t in enumerate(odd_texts(rng))]
    out += [(2000, text(rng, "de", 30), "en", "host-de"), (2001, text(rng, "fr", 30), None, None)]
    out += [(3000, "".join(rng.choice("qxzjkvw0123456789") for _ in range(400)), None, "host-en")]
    return [*out, out[0], (None, text(rng, "en", 20), "en", "host-en")]


def test_documents(spark, rows):
    got = langid.identify(langid.document_evidence(documents(spark, rows))).collect()
    assert len(got) == len(rows)
    by = {r["id"]: r for r in got}
    for doc_id, _, lang, _ in rows[:300]:
        assert by[doc_id]["lang"] == lang and by[doc_id]["accepted"]
    assert by[2000]["lang"] == "de" and by[2001]["lang"] == "fr"
    assert not by[3000]["accepted"]
    assert by[1000]["lang"] == "en" and by[1001]["lang"] == "en"  # no text: what is declared decides
    assert sum(r["id"] == 0 for r in got) == 2 and by[None]["lang"] == "en"


def test_page_evidence(spark):
    pages = [
        (1, "https://news.blog.example.co.uk:80/de/x?y#z", '<html dir="ltr" LANG=\'de-AT\'><style>p{}</style><p>Haus</p><!-- no --></html>', 1),
        (2, "http://example.fr", "<p>plain", 1),
        (3, None, None, 1),
        (4, "not a url", "", 1),
    ]
    got = langid.page_evidence(spark.createDataFrame(pages, "page_id long, url string, html string, host int")).collect()
    assert [(r["id"], r["declared"], r["suffix"], r["host"], r["domain"]) for r in got] == [
        (1, "de", "uk/de", "news.blog.example.co.uk", "example.co.uk"),
        (2, None, "fr/", "example.fr", "example.fr"),
        (3, None, None, None, None),
        (4, None, "/", None, None),
    ]
    assert got[0]["text"].decode().split() == ["Haus"]


def test_hosts_decide_for_texts_that_do_not(spark, rows):
    more = [*rows, (5000, "2024", None, "host-fr"), (5001, "2024", None, "host-de")]
    got = {r["id"]: r["lang"] for r in langid.identify(langid.document_evidence(documents(spark, more))).collect()}
    assert got[5000] == "fr" and got[5001] == "de"


def test_fusion_against_a_slow_one(spark, rows, monkeypatch):
    """Every confidence again, from the text posteriors up, a row and a language at a time; with tables joined either way."""
    more = [*rows, (5000, "2024", None, "www.host-fr.example.co.uk"), (1 << 62, "house river", "en", "a.example.org"), (-(1 << 63), "haus und fluss", "de", None)]
    frame = langid.document_evidence(documents(spark, more))
    langs, models = langid.fit(frame)
    scored = langid.text_likelihoods(frame, models).collect()
    n = range(len(langs))
    own = []
    for r in scored:
        own.append([0.0] * len(langs))
        for s in r["shares"]:
            own[-1][s["k"]] = s["p"]
    total = sum(map(sum, own))
    prior = [(sum(o[k] for o in own) + 1) / (total + len(langs)) for k in n]

    def share(i, key, parent):
        mine = scored[i][key]
        counts = [sum(o[k] for o, r in zip(own, scored, strict=True) if mine is not None and r[key] == mine) for k in n]
        counts = [max(0.0, c - own[i][k]) if mine is not None else 0.0 for k, c in enumerate(counts)]
        return [(c + langid.SMOOTHING * p) / (sum(counts) + langid.SMOOTHING) for c, p in zip(counts, parent, strict=True)]

    want = []
    for i, r in enumerate(scored):
        weight = 0.25 * min(1.0, langid.EVIDENCE_BYTES / max(1, r["size"]))
        logs = [weight * r["ll"][k] + math.log(prior[k]) for k in n]
        for part in (share(i, "declared", prior), share(i, "suffix", prior), share(i, "host", share(i, "domain", prior))):
            logs = [x + math.log(p * (1 - langid.LEAST) + langid.LEAST / len(langs)) - math.log(q) for x, p, q in zip(logs, part, prior, strict=True)]
        parts = [math.exp(x - max(logs)) for x in logs]
        best = parts.index(max(parts))
        want.append((str(r["id"]), langs[best], round(max(parts) / sum(parts), 6)))
    for bound in (100_000, 0):
        monkeypatch.setattr(langid, "BROADCAST_KEYS", bound)
        got = langid.identify(frame).collect()
        assert sorted((str(r["id"]), r["lang"], round(r["confidence"], 6)) for r in got) == sorted(want)


def test_rare_languages_are_modelled_or_pooled(spark, rows, monkeypatch):
    rng = random.Random(20)
    strange = "ek do teen chaar paanch chhe saat aath nau das gyarah barah".split()
    more = [*rows, *((6000 + k, " ".join(rng.choice(strange) for _ in range(40)), lang, None) for k, lang in enumerate(["hi", "hi", "ur"]))]
    got = {r["id"]: r["lang"] for r in langid.identify(langid.document_evidence(documents(spark, more))).collect()}
    assert got[6000] == "hi" and got[6001] == "hi"
    monkeypatch.setattr(langid, "MAX_LANGUAGES", 3)
    got = {r["id"]: r["lang"] for r in langid.identify(langid.document_evidence(documents(spark, more))).collect()}
    assert got[6000] == got[6002] == langid.POOLED


def test_no_labels_and_no_rows(spark):
    got = langid.identify(langid.document_evidence(documents(spark, [(1, "some text")]))).collect()
    assert [(r["id"], r["lang"], r["accepted"]) for r in got] == [(1, None, True)]
    assert langid.identify(langid.document_evidence(documents(spark, []))).collect() == []
