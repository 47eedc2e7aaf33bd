r"""Quality rules as a short-circuit cascade, in DataFrame functions only.

Every rule is a boolean rejection expression over a few measures of a text. On a bounded
sample each rule's cost (seconds to evaluate) and selectivity (share rejected) are measured;
rules then run in the order of rejections per second, and a text that one rule rejects is
not shown to the later, dearer ones. The order changes the work, never the result.

Null text counts as empty: no words, rejected by ``few_words``. Repeated rows are judged one
by one. Extra columns pass through; columns named like a result are replaced.
"""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pipelake.llm.common import blank_words, hash_sample, let, sample_share

WINDOW = 8


def repeated_window_words(words: Column, size: int = WINDOW) -> Column:
    """Number of words inside windows of ``size`` words that occur twice or more in the text.

    Windows are compared by a 64-bit hash of their words. Only a text with an equal pair of
    hashes goes the long way: sort (hash, place), keep places whose neighbour has the same hash,
    and add up what each window covers beyond the one before it.
    """
    codes = F.transform(words, lambda w: F.xxhash64(w))
    starts = F.sequence(F.lit(1), F.size(words) - F.lit(size - 1))

    def window_hash(c: Column, i: Column) -> Column:
        return F.xxhash64(*[F.get(c, i + F.lit(k - 1)) for k in range(size)])

    hashes = let(codes, lambda c: F.transform(starts, lambda i: window_hash(c, i)))

    def places(h: Column) -> Column:
        keyed = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return let(
            keyed,
            lambda k: F.sort_array(
                F.transform(
                    F.filter(k, lambda x, j: (F.get(k, j - 1)["h"] == x["h"]) | (F.get(k, j + 1)["h"] == x["h"])),
                    lambda x: x["i"],
                )
            ),
        )

    def covered(p: Column) -> Column:
        gaps = F.transform(p, lambda x, j: F.least(F.lit(size), F.coalesce(F.get(p, j + 1) - x, F.lit(size))))
        return F.aggregate(gaps, F.lit(0).cast("long"), lambda a, x: a + x)

    def total(h: Column) -> Column:
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(let(places(h), covered))

    return F.when(F.size(words) <= size, F.lit(0).cast("long")).otherwise(let(hashes, total))


def word_chars(words: Column) -> Column:
    return F.length(F.array_join(words, "")).cast("long")


def symbols(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("long")


def duplicate_lines(text: Column) -> Column:
    r"""Lines (split at \n) that have a word and equal an earlier line."""
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    count = let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x)))
    return F.when(F.contains(text, F.lit("\n")), count).otherwise(F.lit(0)).cast("long")


def with_words(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add ``_text`` (null as empty) and ``_words``."""
    return docs.withColumn("_text", F.coalesce(F.col(text), F.lit(""))).withColumn("_words", blank_words(F.col("_text")))


@dataclass(frozen=True)
class QualityRule:
    """``rejects`` is a condition over _text, _words and n_words; true means reject."""

    name: str
    rejects: Column


def base_rules() -> list[QualityRule]:
    """The two rules that every verdict has to honour."""
    n = F.col("n_words")
    return [
        QualityRule("few_words", n < 20),
        QualityRule("repeated_windows", F.lit(100) * repeated_window_words(F.col("_words")) > F.lit(30) * n),
    ]


def method_rules() -> list[QualityRule]:
    """Published heuristics for web text, with their usual limits or milder ones."""
    n, text, words = F.col("n_words"), F.col("_text"), F.col("_words")
    lines = F.size(F.split(text, "\n"))
    return [
        QualityRule("mean_word_length", (word_chars(words) > n * 25) | (word_chars(words) < n * 2)),
        QualityRule("symbol_share", symbols(text) * 10 > n),
        QualityRule("duplicate_lines", duplicate_lines(text) * 2 > lines),
        QualityRule("few_letters", F.size(F.filter(words, lambda w: w.rlike(r"\p{L}"))) * 10 < n * 6),
        QualityRule("ellipsis_lines", F.regexp_count(text, F.lit(r"(?m)(\.\.\.|…)[\x20\x09\x0D]*$")) * 10 > lines * 3),
        QualityRule("bullet_lines", F.regexp_count(text, F.lit(r"(?m)^[\x20\x09]*[-*•]")) * 10 > lines * 9),
        QualityRule("exclamations", F.regexp_count(text, F.lit(r"!!")) * 4 > n),
    ]


@dataclass(frozen=True)
class Estimate:
    name: str
    cost: float
    selectivity: float

    @property
    def rank(self) -> float:
        return self.selectivity / max(self.cost, 1e-9)


def estimate_rules(docs: DataFrame, rules: list[QualityRule], *, key: str, text: str = "text", sample_docs: int = 1000) -> list[Estimate]:
    """Cost and selectivity of each rule on a sample of about ``sample_docs`` documents.

    The sample is chosen by a hash of ``key``. A rule's cost is the time of one aggregate over the
    sample less the time of the same aggregate without a rule.
    """
    picked = docs.where(hash_sample(F.col(key).cast("string"), sample_share(docs.count(), sample_docs))).select(text)
    sample = with_words(picked, text).withColumn("n_words", F.size("_words").cast("long")).persist()
    try:
        total = sample.count()

        def run(condition: Column) -> tuple[float, int]:
            began = time.perf_counter()
            hits = sample.agg(F.sum(condition.cast("long"))).first()[0] or 0
            return time.perf_counter() - began, hits

        run(F.col("n_words") < 0)
        floor = run(F.col("n_words") < 0)[0]
        found = []
        for rule in rules:
            seconds, hits = run(F.coalesce(rule.rejects, F.lit(False)))
            found.append(Estimate(rule.name, max(seconds - floor, 1e-4), hits / max(total, 1)))
        return found
    finally:
        sample.unpersist()


def cascade(rules: list[QualityRule], estimates: list[Estimate]) -> Column:
    """Name of the first rule that rejects, in the order of rejections per cost; null if none does."""
    rank = {e.name: e.rank for e in estimates}
    verdict = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (rank.get(r.name, 0.0), r.name)):
        verdict = F.when(F.coalesce(rule.rejects, F.lit(False)), F.lit(rule.name)).otherwise(verdict)
    return verdict


def quality_filter(docs: DataFrame, *, key: str = "doc_id", text: str = "text", sample_docs: int = 1000) -> DataFrame:
    """Documents that no rule rejects, with their own columns."""
    rules = base_rules() + method_rules()
    order = estimate_rules(docs, rules, key=key, text=text, sample_docs=sample_docs)
    packed = docs.select(F.struct(*docs.columns).alias("_doc"), F.col(text).alias("_source"))
    text_and_words = let(F.coalesce(F.col("_source"), F.lit("")), lambda t: F.struct(t.alias("_text"), blank_words(t).alias("_words")))
    # A filter over a projection would be moved below it and split the text anew for every rule; it stays above a generator.
    judged = packed.select("_doc", F.inline(F.array(text_and_words))).withColumn("n_words", F.size("_words").cast("long"))
    return judged.where(cascade(rules, order).isNull()).select("_doc.*")


def quality_report(docs: DataFrame, *, key: str = "doc_id", text: str = "text", sample_docs: int = 1000) -> DataFrame:
    """key, the five base measures, base_failed and kept for every document."""
    rules = method_rules()
    order = estimate_rules(docs, rules, key=key, text=text, sample_docs=sample_docs)
    words, n = F.col("_words"), F.col("n_words")
    judged = (
        with_words(docs.select(key, text), text)
        .withColumn("n_words", F.size(words).cast("long"))
        .withColumns({
            "word_chars": word_chars(words),
            "n_symbols": symbols(F.col("_text")),
            "n_dup_lines": duplicate_lines(F.col("_text")),
            "n_repeat_words": repeated_window_words(words),
        })
        .withColumn("base_failed", (n < 20) | (F.lit(100) * F.col("n_repeat_words") > F.lit(30) * n))
    )
    kept = F.when(F.col("base_failed"), False).otherwise(cascade(rules, order).isNull())
    return judged.select(key, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept.alias("kept"))
