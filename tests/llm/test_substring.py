import random

import numpy as np
import pytest

from pipelake.llm import substring as S
from tests.llm import brute


def docs(spark, texts):
    return spark.createDataFrame([(i, t, 1) for i, t in texts.items()], "doc_id long, text string, n_words int").repartition(3)


@pytest.mark.parametrize("window, vocabulary", [(3, 3), (5, 4), (13, 2000), (4, 6)])
def test_equals_brute_force(spark, window, vocabulary):
    rng = random.Random(window)
    passages = [[f"p{k}_{i}" for i in range(window + k)] for k in range(4)]
    texts = {}
    for i in range(80):
        words = [f"w{rng.randrange(vocabulary)}" for _ in range(rng.randint(0, 50))]
        if i % 2:
            words[rng.randint(0, len(words)) : 0] = rng.choice(passages)
        texts[i * 7] = " ".join(words)
    texts |= {1000: None, 1001: "", 1002: texts[7], 1003: " ".join(["x"] * 3000), 1004: " ".join(["x"] * 3000), 1005: "A a\n" * 20, 1006: "é\u00a0b " * 20}
    expected = brute.without_repeats(texts, window)
    for r in S.remove_repeats(docs(spark, texts), window=window).collect():
        words = brute.blank_words(texts[r.doc_id])
        assert (r.n_words, r.n_removed, r.kept_text) == (len(words), len(words) - len(expected[r.doc_id]), " ".join(expected[r.doc_id]))


def test_odd_rows(spark):
    text = " ".join(f"w{i}" for i in range(20))
    rows = [(None, text), (None, text), (5, text), (5, text), (6, text)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted((str(r.doc_id), r.n_removed) for r in S.remove_repeats(frame).collect()) == [("5", 0), ("5", 0), ("6", 20), ("None", 0), ("None", 0)]
    assert S.remove_repeats(frame.limit(0)).count() == 0


def test_equal_ids_with_different_texts(spark):
    long, short = " ".join(f"w{i}" for i in range(60)), " ".join(f"v{i}" for i in range(20))
    rows = [(5, short), (5, long), (5, long), (6, short + " " + long), (7, short), (4, "x " + short), (5, None), (5, "v1 v2")]
    got = [(r.doc_id, r.n_words, r.n_removed) for r in S.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert sorted(got) == [(4, 21, 0), (5, 0, 0), (5, 2, 0), (5, 20, 20), (5, 60, 0), (5, 60, 0), (6, 80, 80), (7, 20, 20)]


def test_packing_round_trip():
    arrays = [np.array([1, 2, 1 << 40], np.int64), np.zeros(0, np.int32), np.array([255, 0], np.uint8)]
    assert all((a == b).all() and a.dtype == b.dtype for a, b in zip(arrays, S.unpack(S.pack(*arrays)), strict=True))
    doc, place = np.array([3, 3, 9], np.int64), np.array([0, 70000, 5], np.int32)
    back = S._unplaces(*S._places(doc, place))
    assert (back[0] == doc).all() and (back[1] == place).all()
