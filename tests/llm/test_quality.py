import random

from pyspark.sql import functions as F

from pipelake.llm import quality as Q
from tests.llm import brute

TEXTS = ["", None, "   \n\t", "one", " ".join("abcdefghij") * 3, "a b c d e f g h " * 4, "x " * 300, "line one here\n" * 5, "# | * " * 10, "日本 語 " * 20, "w" * 30000]


def docs(spark, texts):
    return spark.createDataFrame([(i, t, 7) for i, t in enumerate(texts)], "doc_id long, text string, n_words int")


def test_measures_equal_brute_force(spark):
    rng = random.Random(1)
    texts = TEXTS + [" ".join(rng.choice("abc") for _ in range(rng.randint(0, 60))) + rng.choice(["", "\n", " |"]) for _ in range(60)]
    for r in Q.quality_report(docs(spark, texts)).collect():
        text, words = texts[r.doc_id] or "", brute.blank_words(texts[r.doc_id])
        lines = [x for x in text.split("\n") if x.strip(" \t\n\x0b\f\r")]
        repeats = brute.repeat_words(text)
        failed = len(words) < 20 or 100 * repeats > 30 * len(words)
        assert (r.n_words, r.word_chars, r.n_symbols) == (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text))
        assert (r.n_dup_lines, r.n_repeat_words, r.base_failed) == (len(lines) - len(set(lines)), repeats, failed)
        assert not (failed and r.kept)


def test_order_changes_nothing(spark):
    rules = Q.base_rules() + Q.method_rules()
    judged = Q.with_words(docs(spark, TEXTS).drop("n_words")).withColumn("n_words", F.size("_words").cast("long"))
    up = [Q.Estimate(r.name, 1.0, i) for i, r in enumerate(rules)]
    down = [Q.Estimate(r.name, 1.0, -i) for i, r in enumerate(rules)]
    both = judged.select(Q.cascade(rules, up).isNull().alias("a"), Q.cascade(rules, down).isNull().alias("b"))
    assert both.where("a <> b").count() == 0


def test_cheap_selective_rules_go_first():
    a, b = Q.Estimate("a", 2.0, 0.5), Q.Estimate("b", 0.1, 0.1)
    assert b.rank > a.rank


def test_filter_keeps_columns_and_clean_texts(spark):
    clean = "The quick brown fox jumps over the lazy dog while seven other animals watch it from the far side of the river bank today"
    found = Q.quality_filter(docs(spark, [clean, clean, "", None, "short"]))
    assert found.columns == ["doc_id", "text", "n_words"]
    assert sorted((r.doc_id, r.n_words) for r in found.collect()) == [(0, 7), (1, 7)]
    assert Q.quality_report(docs(spark, [])).count() == 0
