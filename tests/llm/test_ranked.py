import math
import random
import re

import pytest

from pipelake.llm import ranked as R

LOWER = {c: c + 32 for c in range(65, 91)}


def terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def brute(docs, items, k):
    bodies = [(i, t) for i, t in ((i, terms(t)) for i, t in docs) if t]
    n_docs, n_terms = len(bodies), sum(len(t) for _, t in bodies)
    df = {}
    for _, body in bodies:
        for t in set(body):
            df[t] = df.get(t, 0) + 1
    wanted = {}
    for item, text in items:
        wanted.setdefault(item, []).extend(terms(text))
    out = []
    for item, words in wanted.items():
        scored = []
        for i, body in bodies:
            m = 25 + 75 * len(body) * n_docs // n_terms
            score = 0
            for t in words:
                tf = body.count(t)
                if tf:
                    score += math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * tf // (1000 * tf + 8 * m))
            if score > 0:
                scored.append((-score, i is not None, i or 0, i))
        out += [(item, r + 1, i, -s) for r, (s, _, _, i) in enumerate(sorted(scored)[:k])]
    return sorted(out, key=str)


def words(rng, n, vocabulary):
    return rng.choice([" ", ", ", "\n-"]).join(f"{rng.choice('aBéZ')}{int(vocabulary * rng.random() ** 3)}" for _ in range(n))


@pytest.mark.parametrize("chunk_bytes, block_items, vocabulary", [(1 << 22, 256, 500), (700, 3, 60), (3000, 1, 8)])
def test_equals_brute_force(spark, chunk_bytes, block_items, vocabulary):
    rng = random.Random(vocabulary)
    docs = [(i * 3, words(rng, rng.randint(0, 60), vocabulary)) for i in range(150)]
    docs += [(900, None), (901, ""), (902, "... !"), (903, docs[4][1]), (903, docs[4][1]), (None, docs[4][1]), (905, "a1 " * 400), (906, words(rng, 6000, 9000)), (2, docs[7][1])]
    items = [(i, words(rng, rng.randint(1, 20), vocabulary)) for i in range(9)] + [(20, None), (21, "nowhere"), (22, "a1 a1 A1"), (22, docs[4][1]), (None, docs[4][1])]
    frame = spark.createDataFrame([(i, t, "x", 1) for i, t in docs], "doc_id long, text string, head string, rank int").repartition(4)
    index = R.build_index(frame, chunk_bytes=chunk_bytes)
    got = R.search(index, spark.createDataFrame([(i, t, 1, 2) for i, t in items], "item_id long, text string, n int, term int"), k=5, block_items=block_items)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(map(tuple, got.collect()), key=str) == brute(docs, items, 5)


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    items = spark.createDataFrame([("x", "a")], "item_id string, text string")
    assert R.search(R.build_index(docs.limit(0)), items).collect() == []
    assert R.search(R.build_index(docs), items.limit(0)).collect() == []
    assert [tuple(r)[:3] for r in R.search(R.build_index(docs), items).collect()] == [("x", 1, 1)]


def test_equals_duckdb(spark):
    duckdb = pytest.importorskip("duckdb")
    from pipelake.llm.queries import OP12_SQL

    rng = random.Random(9)
    docs = [(i, words(rng, rng.randint(0, 60), 300)) for i in range(200)] + [(300, None)]
    items = [(i, words(rng, rng.randint(1, 20), 300)) for i in range(12)]
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.execute("CREATE TABLE benchmark (item_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", docs)
    con.executemany("INSERT INTO benchmark VALUES (?, ?)", items)
    assert sorted(con.execute(OP12_SQL).fetchall(), key=str) == brute(docs, items, 10)
