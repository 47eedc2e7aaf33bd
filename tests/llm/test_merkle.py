import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from pipelake.llm import merkle as M

COLUMNS = ["doc_id", "source", "lang", "n_chars", "text"]
LOWER = {c: c + 32 for c in range(65, 91)}


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(row):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def brute(rows):
    """(doc_id, leaf, subroot, root, proof, folded, verified) of (doc_id, source, lang, n_chars, text) rows."""

    def climb(level, place, claim, proof):
        """Top of a list of digests, and the top and siblings when the one at place has another digest."""
        while len(level) > 1:
            first = place // 8 * 8
            run = level[first : first + 8]
            others = run[: place - first] + run[place - first + 1 :]
            claim = sha("".join([*run[: place - first], claim, *run[place - first + 1 :]]))
            proof += others
            level, place = [sha("".join(level[i : i + 8])) for i in range(0, len(level), 8)], place // 8
        return level[0], claim, proof

    groups = {}
    for row in rows:
        groups.setdefault(row[2], []).append(row)
    for group in groups.values():
        group.sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
    langs = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    tops = [climb([leaf(r) for r in groups[g]], 0, "", [])[0] for g in langs]
    out = []
    for q, g in enumerate(langs):
        leaves = [leaf(r) for r in groups[g]]
        for p, row in enumerate(groups[g]):
            altered = row[0] is not None and zlib.crc32(str(row[0]).encode()) % 3 == 0
            claim = leaf((*row[:4], row[4] and row[4].translate(LOWER))) if altered else leaves[p]
            subroot, claim, proof = climb(leaves, p, claim, [])
            root, claim, proof = climb(tops, q, claim, proof)
            out.append((row[0], leaves[p], subroot, root, sha("".join(proof)), claim, claim == root))
    return sorted(out, key=str)


def found(frame):
    altered = M.leaf_digest([F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz") if c == "text" else F.col(c) for c in COLUMNS])
    built = M.build(frame, columns=COLUMNS, carry={"claimed": F.when(F.crc32(F.col("doc_id").cast("string")) % 3 == 0, altered)}).leaves
    got = built.select("key", "leaf", "subroot", "root", M.siblings_digest(F.col("path")), M.fold(F.coalesce("claimed", "leaf"), F.col("path")).alias("f"))
    return sorted((tuple(r) + (r.f == r.root,) for r in got.collect()), key=str)


SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, grp int, key int, digest int, lo int"


@pytest.mark.parametrize("sizes", [{"en": 1}, {"en": 9, None: 8, "é": 65, "": 1, "zz": 7}, {f"l{i}": 1 + i % 3 for i in range(11)} | {"en": 530}])
def test_equals_brute_force(spark, sizes):
    rng = random.Random(5)
    rows = []
    for lang, n in sizes.items():
        for _ in range(n):
            rows.append((rng.randrange(10**6), rng.choice(["A", None, "b:1"]), lang, rng.choice([None, 3]), rng.choice([None, "", "Ab C", "lower", "É 日本"])))
    rows += [rows[0]] * 3 + [(None, "x", "en", 1, "Y"), (rows[0][0], "again", "en", 0, "Z")]
    frame = spark.createDataFrame([(*r, 1, 2, 3, 4) for r in rows], SCHEMA).repartition(3)
    assert found(frame) == brute(rows)


def test_empty(spark):
    assert found(spark.createDataFrame([], SCHEMA)) == []


def test_equals_duckdb(spark):
    duckdb = pytest.importorskip("duckdb")
    from pipelake.llm.queries import OP13_SQL

    rng = random.Random(6)
    rows = [(i, "s", rng.choice([None, "en", "de", "ü"]), rng.choice([None, 3]), rng.choice([None, "Ab", "x", "É"])) for i in range(0, 900, 3)]
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, source VARCHAR, lang VARCHAR, n_chars BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?, ?, ?, ?)", rows)
    assert sorted(con.execute(OP13_SQL).fetchall(), key=str) == brute(rows)
