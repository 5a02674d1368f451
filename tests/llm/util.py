"""Small inputs that every operator must take."""

import random

DOCS = "doc_id long, text string, lang string, source string, n_chars long, id long, fp string, component int, n int"


def documents(spark, rows):
    """Rows ``(doc_id, text[, lang, source])`` with further columns whose names clash with internal ones."""
    full = []
    for r in rows:
        doc_id, text, lang, source = (*r, *(None,) * (4 - len(r)))
        full.append((doc_id, text, lang, source, None if text is None else len(text), 7, "x", 1, 2))
    return spark.createDataFrame(full, DOCS)


def words(rng: random.Random, n: int, vocabulary: int = 400) -> list[str]:
    return [f"{'bcdfgklmnprst'[k % 13]}{'aeiou'[k % 5]}{'lmnrst'[k % 6]}{k}" for k in (rng.randrange(vocabulary) for _ in range(n))]


def odd_texts(rng: random.Random) -> list[str | None]:
    """Null, empty, blank, one character, not ASCII, control marks, and a very long text."""
    return [None, "", " \n\t ", "x", "ÄÖÜ ß ĳ́ naïve 漢字 🙂", "<|endoftext|> <|im_end|>", " ".join(words(rng, 60_000))]
