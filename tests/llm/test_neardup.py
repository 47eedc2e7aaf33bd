import math
import random

import pytest

from pipelake.llm import neardup as N
from pipelake.llm.graph import components
from tests.llm import brute


def docs(spark, texts):
    return spark.createDataFrame([(i, t, "own") for i, t in texts.items()], "doc_id long, text string, kept string").repartition(3)


def edited(rng, words, edits):
    words = list(words)
    for _ in range(edits):
        words[rng.randrange(len(words))] = f"new{rng.random()}"
    return " ".join(words)


@pytest.mark.parametrize("size, seed", [(2, 1), (5, 2)])
def test_components_equal_brute_force(spark, size, seed):
    rng = random.Random(seed)
    passage = [f"p{i}" for i in range(60)]
    texts, i = {}, 0
    for length in (3, 5, 6, 8, 12, 20, 40, 90, 200, 400):
        base = [f"w{rng.randrange(4000)}" for _ in range(length)]
        for copy in range(5):
            texts[i] = edited(rng, base, rng.randrange(0, 1 + length // 12) if copy else 0)
            i += 1
    for _ in range(60):
        texts[i] = " ".join(passage + [f"w{rng.randrange(4000)}" for _ in range(80)])
        i += 1
    texts |= {i: "", i + 1: None, i + 2: "one", i + 3: "ONE", i + 4: "  ", i + 5: "É", i + 6: "é"}
    found = {r.doc_id: r for r in N.near_duplicates(docs(spark, texts), size=size, percent=80).collect()}
    expected = brute.near_components(texts, size, 80)
    assert {j: r.component_id for j, r in found.items()} == expected
    assert all(r.n_shingles == len(brute.shingles(texts[j], size)) and r.kept == (expected[j] == j) for j, r in found.items())


def test_large_groups_cost_linear_links(spark):
    rng = random.Random(3)
    base = [f"w{i}" for i in range(150)]
    texts = {i: edited(rng, base, 3) for i in range(300)} | {i: "same words again and again" for i in range(300, 500)}
    found = N.near_duplicates(docs(spark, texts), size=2, percent=80).collect()
    assert {r.component_id for r in found} == {0, 300}


def test_odd_rows(spark):
    rows = [(None, "a b c", "x"), (None, "a b c", "x"), (1, "a b c", "x"), (1, "a b c", "x"), (2, "A b C", "x")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, kept string")
    found = sorted((str(r.doc_id), str(r.component_id), r.kept) for r in N.near_duplicates(frame, size=2).collect())
    assert found == [("1", "1", True), ("1", "1", True), ("2", "1", False), ("None", "None", True), ("None", "None", True)]
    assert [(str(r.doc_id), r.kept) for r in N.deduplicate(frame, size=2).orderBy("doc_id").collect()] == [("None", "x"), ("None", "x"), ("1", "x"), ("1", "x")]
    assert N.near_duplicates(frame.limit(0), size=2).count() == 0


def test_sketch_filter_misses_next_to_no_pair_at_the_limit():
    floor, k = N._least_common(80, 80), 80
    missed = sum(math.comb(k, i) * 0.8**i * 0.2 ** (k - i) for i in range(k + 1) if i < floor * k)
    assert missed < 1e-7


def test_components_of_a_long_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(100)] + [(500, 501)], "a long, b long")
    assert {r.node: r.component for r in components(links).collect()} == {i: 0 for i in range(101)} | {500: 500, 501: 500}


def rare_pairs(spark, texts, component, most):
    rows = [(i, len(brute.shingles(t, 2)), component(i)) for i, t in texts.items()]
    nodes = spark.createDataFrame(rows, "node long, n long, c long")
    members = spark.createDataFrame(list(texts.items()), "node long, text string")
    return [(r.a, r.b) for r in N.by_rare_values(nodes, members, size=2, percent=80, most=most).collect()]


@pytest.mark.parametrize("most", [2048, 64])
def test_rare_values_meet_every_linked_pair_of_two_components(spark, most):
    rng = random.Random(5)
    texts = {}
    for length in (2, 3, 6, 11, 30, 70, 150):
        base = [f"w{rng.randrange(3000)}" for _ in range(length)]
        for copy in range(12):
            cut = rng.randrange(0, 1 + length // 8)
            texts[len(texts)] = edited(rng, base[: length - cut] if copy % 2 else base[cut:], rng.randrange(0, 1 + length // 16))
    component = lambda i: i % 5
    found = set(rare_pairs(spark, texts, component, most))
    sets = {i: brute.shingles(t, 2) for i, t in texts.items()}
    linked = {(a, b) for a in sets for b in sets if a < b and component(a) != component(b) and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])}
    assert len(linked) > 50 and linked <= found


def test_copies_edited_too_far_meet_nobody(spark):
    rng = random.Random(6)
    base = [f"w{i}" for i in range(150)]
    texts = {i: edited(rng, base, 15) for i in range(120)}
    assert len(rare_pairs(spark, texts, lambda i: i, 2048)) < 120


def test_copies_around_a_pivot_meet_by_their_differences(spark):
    rng = random.Random(7)
    base = [f"w{i}" for i in range(150)]

    def copy(edits):
        words = list(base)
        for _ in range(edits):
            at = rng.randrange(len(words))
            words[at : at + 1] = rng.choice(([], [f"x{rng.randrange(3)}"], [words[at], words[at]]))
        return " ".join(words)

    texts = {0: " ".join(base)} | {i: copy(i % 14) for i in range(1, 330)} | {i: copy(16) for i in range(330, 340)}
    for i in range(340, 360):
        texts[i] = texts[330 + i % 10] + f" y{i}"
    sets = {i: brute.shingles(t, 2) for i, t in texts.items()}
    alike = lambda a, b: 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])
    component = {i: 0 if alike(0, i) and i % 5 else i for i in texts}
    nodes = spark.createDataFrame([(i, len(sets[i]), component[i], 0) for i in texts], "node long, n long, c long, pivot long")
    members = spark.createDataFrame(list(texts.items()), "node long, text string")
    found = {(r.a, r.b) for r in N.by_rare_values(nodes, members, size=2, percent=80).collect()}
    linked = {(a, b) for a in sets for b in sets if a < b and component[a] != component[b] and alike(a, b)}
    stars = {(0, b) for b in sets if component[b] and alike(0, b)}
    assert len(stars) > 20 and stars <= found
    tested = {(a, b) for a, b in linked if not (alike(0, a) and alike(0, b))}
    assert len(tested) > 25 and tested <= found
    met = N.by_rare_values(nodes.drop("pivot"), members, size=2, percent=80).select("a", "b").distinct().count()
    assert 2 * len(found) < met
