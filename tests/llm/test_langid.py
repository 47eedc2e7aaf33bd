import random

from pipelake.llm import langid as L

WORDS = {"en": "the and of to in that is was for with".split(), "de": "der die und in den von zu das mit ist".split(), "fr": "le la les des et est dans pour que une".split(), "es": "el los las una y que en por con del".split()}


def table(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, score int")


def corpus(n=400, seed=4):
    rng = random.Random(seed)
    return [(i, " ".join(rng.choice(WORDS[lang]) for _ in range(12)), lang, 1) for i in range(n) for lang in [rng.choice(list(WORDS))]]


def test_held_out_accuracy(spark):
    rows = corpus()
    found = {r.doc_id: r for r in L.identify(table(spark, rows)).collect()}
    held = [r for r in rows if found[r[0]].held_out]
    assert 50 < len(held) < 120
    assert sum(found[i].lang_pred == lang for i, _, lang, _ in held) >= 0.95 * len(held)
    assert all(0 <= r.score <= 1 for r in found.values())


def test_labels_of_held_out_rows_do_not_matter(spark):
    import zlib

    rows = corpus(200)
    changed = [(i, t, "xx" if zlib.crc32(str(i).encode()) % 5 == 0 else lang, s) for i, t, lang, s in rows]
    a = {r.doc_id: (r.lang_pred, r.score) for r in L.identify(table(spark, rows)).collect()}
    b = {r.doc_id: (r.lang_pred, r.score) for r in L.identify(table(spark, changed)).collect()}
    assert a == b


def test_odd_rows(spark):
    rows = corpus(100) + [(900, None, "en", 1), (901, "", "en", 1), (902, "123 !?", None, 1), (None, "the and of", None, 1), (904, "der die " * 20000, None, 1), (904, "der die " * 20000, None, 1)]
    found = L.identify(table(spark, rows)).collect()
    odd = [r for r in found if r.doc_id is None or r.doc_id >= 900]
    assert len(found) == 106
    assert sorted((str(r.doc_id), r.lang_pred) for r in odd) == [("900", "und"), ("901", "und"), ("902", "und"), ("904", "de"), ("904", "de"), ("None", "en")]
    assert all(r.lang_pred == "und" and r.score == 0 for r in L.identify(table(spark, [(1, "abc", None, 1)])).collect())
    assert L.identify(table(spark, [])).count() == 0


def brute_vector(text):
    """n-gram counts in plain Python integers."""
    data = bytes(b if b >= 128 or chr(b).isalpha() else 32 for b in b" " + text.encode().lower() + b" ")
    wide, counts = (1 << 32) - 1, {}
    for i in range(len(data)):
        value = None
        for n, factors in ((2, (0x9E3779B1, 0x85EBCA77)), (3, (0xC2B2AE3D, 0x27D4EB2F)), (4, (0x165667B1, 0x9E3779B1))):
            if i + n > len(data):
                break
            before = data[i] if n == 2 else value
            value = (before * factors[0] + data[i + n - 1] * factors[1]) & wide
            at = ((value * 0x9E3779B1) & wide) >> 20
            counts[at] = counts.get(at, 0) + 1
    size = sum(counts.values()) ** 0.5
    return {at: n**0.5 / size for at, n in counts.items()}


def brute_prediction(model, text):
    """Family by the largest margin, then votes of all pairs in it; ties by the summed margins."""
    import math

    if not any(c.isalpha() for c in text or ""):
        return "und", 0.0
    vector = brute_vector(text)
    margin = lambda w: sum(v * float(w[at]) for at, v in vector.items()) + float(w[-1])
    sure = lambda m: 1 / (1 + math.exp(-max(-30, min(30, 2 * m))))
    margins = [margin(w) for w in model.family_weights]
    best = max(range(len(margins)), key=lambda f: margins[f])
    members = model.families[best][1]
    score = sure(margins[best] - sorted(margins)[-2]) if len(model.families) > 1 else 1.0
    votes, sums = dict.fromkeys(members, 0), dict.fromkeys(members, 0.0)
    for (a, b), w in model.pairs.items():
        if a in votes:
            m = margin(w)
            votes[a if m >= 0 else b] += 1
            sums[a] += m
            sums[b] -= m
    name = max(members, key=lambda x: votes[x] + math.tanh(sums[x]) / 4)
    return name, score * (sure(sums[name] / (len(members) - 1) * 2) if len(members) > 1 else 1.0)


def test_predictions_equal_brute_force(spark):
    from pyspark.sql import functions as F

    rows = corpus(300, seed=8) + [(900, None, "en", 1), (901, " 12 ", "en", 1), (902, "él ñandú straße", None, 1), (903, "the der le el " * 50, None, 1)]
    frame = table(spark, rows)
    model = L.train(frame.where(F.crc32(F.col("doc_id").cast("string")) % 5 != 0), key="doc_id", text="text", language="lang")
    texts = {r[0]: r[1] for r in rows}
    for r in L.identify(frame).collect():
        name, score = brute_prediction(model, texts[r.doc_id])
        assert r.lang_pred == name and abs(r.score - score) < 1e-3
