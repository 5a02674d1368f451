import random

from pressmill.llm import decontaminate
from tests.llm.util import documents, odd_texts, words

ITEM = "A farmer named Jones has 12 apples and sells 5 of them for 3 dollars each so how much money does Jones make in total today"


def found(spark, docs, items):
    items = spark.createDataFrame(items, "item_id long, text string, doc_id int")
    got = decontaminate.contaminated(documents(spark, docs), items).collect()
    return sorted((r["id"], r["item"]) for r in got)


def test_same_and_reparameterised_questions(spark):
    rng = random.Random(5)
    noise = lambda n: " ".join(words(rng, n))
    again = ITEM.replace("Jones", "Smith").replace("12", "40,5").replace("5 of", "31 of").replace("dollars", "euros")
    mixed = ITEM.replace("Jones has", "Smith has")  # one name became two: what agrees still counts
    docs = [
        (1, f"{noise(50)}\n{ITEM}\n{noise(50)}"),
        (2, f"{noise(50)} {again} {noise(5)}"),
        (3, f"{noise(30)}\n{mixed}"),
        (4, noise(500)),
        (5, " ".join(ITEM.split()[:11])),
        (6, f"{ITEM.upper()}"),
        (7, f"{ITEM.replace(' has', ', has')}!!"),
        (1, f"{noise(50)}\n{ITEM}\n{noise(50)}"),
    ]
    plain = " ".join(words(rng, 30))
    docs.append((8, f"start {plain} end"))
    items = [(10, ITEM, 1), (11, plain, 1), (12, "too short", 1), (13, None, 1), (13, "", 1)]
    # all of a short item's names must agree: here no window without the lesser value is left
    few = "the day Jones met little Smith near old Jones today"
    docs += [(9, f"{noise(20)} {few.replace('Jones met', 'Brown met')} {noise(20)}"), (11, f"{noise(20)} {few.replace('Jones', 'Brown')} {noise(20)}")]
    items.append((14, few, 1))
    assert found(spark, docs, items) == [(1, 10), (2, 10), (3, 10), (6, 10), (7, 10), (8, 11), (11, 14)]


def test_windows_against_brute_force(spark):
    rng = random.Random(6)
    items = [(k, " ".join(words(rng, rng.randrange(5, 40), 3000)), 0) for k in range(20)]
    docs = [(k, t) for k, t in enumerate(odd_texts(rng))]
    for k in range(100, 160):
        piece = items[k % 20][1].split()
        lo = rng.randrange(len(piece))
        docs.append((k, " ".join(words(rng, 20, 3000) + piece[lo : lo + rng.randrange(1, 40)] + words(rng, 20, 3000))))

    def grams(text):
        w = text.split()
        return [tuple(w[i : i + 8]) for i in range(len(w) - 7)]

    want = []
    for doc, text in docs:
        own = set(grams(text or ""))
        for item, t, _ in items:
            hits = sum(g in own for g in grams(t))
            if hits and hits >= min(6, len(grams(t))):
                want.append((doc, item))
    assert found(spark, docs, items) == sorted(want)


def test_reparameterised_questions_are_caught(spark):
    """Questions asked again with other numbers, number words, names and units: recall of at least 0.9, nothing else found."""
    rng = random.Random(31)
    people = "Anna Boris Clara David Emma Felix Greta Hugo Irene Jonas".split()
    things = "apples boats pens books stones lamps chairs".split()
    units = ["kilograms", "pounds", "grams", "ounces"]
    counts = ["7", "9", "12", "31", "2,5", "twelve", "forty-one", "three", "1,200"]
    forms = [
        "{a} has {n} {x} in the old basket. {a} gives {m} of them to {b} before lunch. How many does {a} have left at the end?",
        "\u201c{a} {c} bought {n} {u} of flour and {m} {u} of sugar for the bakery,\u201d she wrote, so what did the whole bag weigh that day?",
        "On a lake there are {n} red {x} and {n} blue {x}, and each of them carries {m} people across the water every single day.",
    ]

    def fill(form, rng):
        a, b, c = rng.sample(people, 3)
        return form.format(a=a, b=b, c=c, n=rng.choice(counts), m=rng.choice(counts), u=rng.choice(units), x="{x}").replace("{x}", thing)

    items, docs, want = [], [], set()
    for k in range(21):
        thing, form = things[k % 7], forms[k // 7]
        items.append((k, fill(form, rng), 0))
        for j in range(3):
            again = fill(form, rng)
            if j == 2:  # numbers that were equal become different ones, and one name is another
                again = " ".join(rng.choice(counts) if w in counts else w for w in again.split())
            docs.append((100 * k + j, " ".join([*words(rng, 30), again, *words(rng, 30)])))
            want.add((100 * k + j, k))
        docs.append((100 * k + 50, " ".join(words(rng, 90))))
    verbatim = "there were 7 boats and 7 sailors near the small harbour wall so all of them had to wait there until noon"
    items.append((900, verbatim, 0))
    docs += [(9000, verbatim.replace("7 boats", "9 boats").replace("7 sailors", "4 sailors")), (9001, verbatim.replace("7 boats", "8 boats")), (9002, verbatim.replace("7", "seven"))]
    want |= {(9000, 900), (9001, 900), (9002, 900)}
    got = set(found(spark, docs, items))
    assert len(got & want) >= 0.9 * len(want) and {d for d, _ in got} <= {d for d, _ in want}


def test_repeated_ids_and_null_ids_with_hits(spark):
    other = ITEM.replace("farmer", "baker")
    docs = [(1, ITEM), (1, "nothing here"), (None, f"so {ITEM}"), (2, None), (None, None)]
    items = spark.createDataFrame([(10, ITEM, 1), (10, other, 1), (None, ITEM, 1)], "item_id long, text string, doc_id int")
    got = decontaminate.contaminated(documents(spark, docs), items).collect()
    assert {(r["id"], r["item"]) for r in got} == {(1, 10), (1, None), (None, 10), (None, None)} and len(got) == 4


def test_shuffled_join_and_empty_tables(spark, monkeypatch):
    assert found(spark, [], [(1, ITEM, 0)]) == [] and found(spark, [(1, ITEM)], []) == []
    monkeypatch.setattr(decontaminate, "BROADCAST_WINDOWS", 0)
    assert found(spark, [(1, ITEM), (None, None)], [(1, ITEM, 0)]) == [(1, 1)]


def test_items_without_a_window_are_found_whole(spark):
    items = [(1, "What is the capital of France?", 0), (2, "12 + 7 - 3 * 4 / 2 + 81 - 6", 0), (3, "Berlin Hamburg Bremen", 0)]
    docs = [
        (1, "We asked: what is the capital of France? Nobody knew."),
        (2, "what is the capital of it"),
        (3, "so 12 + 7 - 3 * 4 / 2 + 81 - 6 it is"),
        (4, "so 13 + 7 - 3 * 4 / 2 + 81 - 6 it is"),  # numbers alone must be the item's
        (5, "in Berlin Hamburg Kiel"),
    ]
    assert found(spark, docs, items) == [(1, 1), (3, 2)]
