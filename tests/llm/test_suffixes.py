import hashlib
import random

import pytest

from pipelake.llm import suffixes as S


def brute(rows, length):
    """(removed mask, kept) of each (id, text); ids may repeat."""
    first = {}
    data = [(i, (t or "").encode()) for i, t in rows]
    for i, b in data:
        if i is not None:
            for p in range(len(b) - length + 1):
                s = b[p : p + length]
                first[s] = min(first.get(s, (i, p)), (i, p))
    out = []
    for i, b in data:
        gone = bytearray(len(b))
        for p in range(len(b) - length + 1):
            if i is not None and first[b[p : p + length]] < (i, p):
                gone[p : p + length] = b"\1" * length
        spans = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        out.append((str(i), len(b), sum(gone), spans, bytes(x for x, g in zip(b, gone) if not g)))
    return sorted(out)


def found(spark, rows, length, **more):
    frame = spark.createDataFrame([(i, t, "x", b"") for i, t in rows], "doc_id long, text string, chunk string, blob binary").repartition(3)
    got = S.remove_repeated_strings(frame, length=length, **more).collect()
    return sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in got)


@pytest.mark.parametrize("length, chunk_bytes", [(10, 1 << 20), (21, 500), (40, 2000), (100, 900), (100, 1 << 20)])
def test_equals_brute_force(spark, length, chunk_bytes):
    rng = random.Random(length + chunk_bytes)
    passages = ["".join(rng.choice("abcdé\n ") for _ in range(length + 37 * k)) for k in range(5)]
    rows = []
    for i in range(70):
        text = "".join(rng.choice("ab c") if i % 3 else rng.choice("ab") for _ in range(rng.randint(0, 3 * length)))
        for _ in range(rng.randint(0, 3)):
            at = rng.randint(0, len(text))
            text = text[:at] + rng.choice(passages)[rng.randint(0, 9) :] + text[at:]
        rows.append(((i * 37) % 71, text))
    rows += [(900, None), (901, ""), (902, rows[5][1]), (903, "x" * 3000), (904, "x" * 3000), (905, "ab" * 1500), (0, rows[9][1]), (-4, passages[4])]
    assert found(spark, rows, length, chunk_bytes=chunk_bytes) == brute(rows, length)


def test_odd_rows(spark):
    text = "".join(chr(97 + i % 26) + str(i) for i in range(80))
    rows = [(None, text), (None, text), (5, text), (5, text), (5, "ab" + text), (6, text), (7, text[:-1]), (7, text[:-1])]
    assert found(spark, rows, 50) == brute(rows, 50)
    assert found(spark, [], 50) == []


@pytest.mark.parametrize("period", sorted(S.COVERS))
def test_covers_hold_every_difference(period):
    assert {(a - b) % period for a in S.COVERS[period] for b in S.COVERS[period]} == set(range(period))


def test_equals_duckdb(spark):
    duckdb = pytest.importorskip("duckdb")
    from pipelake.llm.queries import OP11_SQL

    rng = random.Random(3)
    passages = ["".join(rng.choice("abcdé\n ") for _ in range(90 + 37 * k)) for k in range(5)]
    rows = [(k, " ".join(rng.choice(passages) for _ in range(rng.randint(0, 4)))) for k in range(60)] + [(99, None), (98, "")]
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", rows)
    got = [(i, n, r, s, hashlib.sha256(k).hexdigest()) for i, n, r, s, k in ((int(i), n, r, s, k) for i, n, r, s, k in found(spark, rows, 100))]
    assert sorted(got) == sorted(con.execute(f"SELECT doc_id, n_bytes, n_removed, n_spans, kept_sha256 FROM ({OP11_SQL})").fetchall())
