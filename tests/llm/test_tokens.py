import random

from pressmill.llm import tokens
from tests.llm.util import documents, odd_texts, words


def test_histogram_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(tokens, "BLOCK", 16)
    rng = random.Random(7)
    texts = [*odd_texts(rng), *(" ".join(words(rng, rng.randrange(0, 40))) for _ in range(60))]
    texts.append(texts[-1])
    count = tokens.encoding(tokens.vocabulary_path(tokens.BYTE_BPE)).encode_ordinary
    n = [len(count(t or "")) for t in texts]
    lengths = tokens.token_lengths(documents(spark, list(enumerate(texts))))
    assert sorted(tuple(r) for r in lengths.collect()) == list(enumerate(n))
    hist = tokens.length_histogram(lengths)
    got = {r["n_tokens"]: r for r in hist.collect()}
    assert set(got) == set(n)
    for limit, r in got.items():
        assert r["docs"] == n.count(limit)
        assert r["docs_upto"] == sum(x <= limit for x in n) and r["docs_over"] == sum(x > limit for x in n)
        assert r["tokens_upto"] == sum(x for x in n if x <= limit)
        assert r["truncated_tokens"] == sum(min(x, limit) for x in n) == sum(n) - r["lost_tokens"]
        assert r["quantile"] == r["docs_upto"] / len(n)
    for limit in (0, 1, 33, 500, 10**9):
        assert tokens.tokens_at_limit(hist, limit) == sum(min(x, limit) for x in n)
    assert tokens.length_quantile(hist, 0.5) == sorted(n)[-(-len(n) // 2) - 1]


def test_null_and_repeated_ids(spark):
    got = tokens.token_lengths(documents(spark, [(1, "a b"), (1, "a b"), (None, "a b"), (None, None)])).collect()
    assert sorted((r["id"] or 0, r["n"]) for r in got) == [(0, 0), (0, 2), (1, 2), (1, 2)]


def test_empty_table(spark):
    assert tokens.tokens_at_limit(tokens.length_histogram(tokens.token_lengths(documents(spark, []))), 10) == 0
    assert tokens.length_histogram(tokens.token_lengths(documents(spark, []))).collect() == []
