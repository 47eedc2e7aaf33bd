import random

from pipelake.llm import decontam as D
from tests.llm import brute


def docs(spark, texts):
    return spark.createDataFrame([(i, t, 1) for i, t in texts.items()], "doc_id long, text string, n_hit int").repartition(3)


def bench(spark, items):
    return spark.createDataFrame(items, "item_id long, text string")


def found(spark, texts, items, window):
    return {r.doc_id: (r.n_words, r.n_hit, r.items) for r in D.contamination(docs(spark, texts), bench(spark, items), window=window).collect()}


def test_equals_brute_force(spark):
    rng = random.Random(6)
    word = lambda: rng.choice(["the", "of", "a"] * 6 + [f"w{i}" for i in range(30)])
    items = [(i, " ".join(word() for _ in range(rng.choice([0, 1, 2, 4, 6, 12])))) for i in range(25)] + [(99, "The OF a"), (98, "the of a"), (97, None)]
    texts = {}
    for i in range(60):
        words = [word() for _ in range(rng.randint(0, 40))]
        if i % 2:
            at = rng.randint(0, len(words))
            words[at:at] = (items[rng.randrange(25)][1] or "").split()
        texts[i] = rng.choice([" ", ", ", "\n"]).join(words)
    texts |= {100: None, 101: "", 102: "é" * 3, 103: "the of a " * 5000}
    assert found(spark, texts, items, 4) == brute.contaminated(texts, items, 4)


def test_decisions_and_odd_rows(spark):
    items = [(1, "alpha beta gamma delta")]
    texts = {1: "x alpha beta gamma y", 2: "clean words only here", 3: None}
    frame = docs(spark, texts).union(spark.createDataFrame([(None, "alpha beta gamma", 1), (None, "fine", 1)], "doc_id long, text string, n_hit int"))
    kept = D.decontaminate(frame, bench(spark, items), window=3)
    assert kept.columns == ["doc_id", "text", "n_hit"]
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["2", "3"]
    assert found(spark, texts, [], 3)[1] == (5, 0, [])
    assert found(spark, {}, items, 3) == {}


def test_one_word_over_and_over_stays_linear(spark):
    items = [(1, "ha " * 5000), (2, "ha " * 12), (3, "ha " * 4), (4, "so la " * 2500), (5, "ha " * 9 + "end")]
    texts = {1: "ha " * 50_000, 2: "so la " * 25_000, 3: "ha " * 9, 4: "x " + "ha " * 10 + "y", 5: "ha " * 10 + "end"}
    expected = {1: (50_000, 50_000, ["1", "2", "3"]), 2: (50_000, 50_000, ["4"]), 3: (9, 9, ["3"]), 4: (12, 10, ["1", "2", "3"]), 5: (11, 11, ["1", "2", "3", "5"])}
    assert found(spark, texts, items, 10) == expected


def test_clashing_names(spark):
    frame = docs(spark, {1: "x alpha beta gamma y", 2: "fine"}).selectExpr("*", "1 AS _hit", "2 AS seg", "3 AS starts", "4 AS hit", "5 AS _doc", "6 AS lines")
    kept = D.decontaminate(frame, bench(spark, [(1, "alpha beta gamma")]), window=3)
    assert [r.doc_id for r in kept.collect()] == [2] and kept.columns == frame.columns


def test_proximity(spark):
    frame = docs(spark, {1: "rare x x other", 2: "rare x x x x x other", 3: "other rare"})
    terms = spark.createDataFrame([("rare",), ("other",)], "term string")
    index = D.build_index(frame, terms, key="doc_id", text="text")
    pairs = spark.createDataFrame([("p", "rare", "other")], "pair string, term_1 string, term_2 string")
    assert sorted(r.doc_id for r in D.near_matches(index, pairs, 3).collect()) == [1, 3]
