r"""Benchmark decontamination by a positional inverted index, in DataFrame functions only.

1. Corpus frequencies of the benchmark's terms are counted over all documents. Every window of ``window``
   words of a benchmark item gets its two rarest terms. Neighbouring windows with one rarest place form a segment, of fewer than two windows' words;
   equal segments, of one item or of many, are one.
2. The index: postings (term, document, position) of those rare terms, over all documents, stored in the shared
   folder. Terms that no window needs first or second are never posted.
3. Intersection from the rarest term: a posting of a segment's rarest term fixes where the segment would start in the
   document. The second list has to have the posting that this start asks for.
4. What two lists agree on is compared word by word with the document, so matches are exact phrases. A document's row gets each of its segments once,
   with the starts as numbers, so texts and items of one word over and over stay linear.
   ``near_matches`` answers proximity questions from the same index.

Words are ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` after lower-casing A-Z. An item with fewer words than a window, but not
none, is one window. Null texts have no words. Equal items count as one text with several ids. Documents with a null id, and
repeated ones, are judged like all others. An empty benchmark leaves every document clean.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pipelake.llm.common import ascii_lower, written

#: Tables of benchmark terms up to this many rows are broadcast; larger ones are joined by shuffle.
BROADCAST_ROWS = 200_000


def index_words(text: Column) -> Column:
    lowered = ascii_lower(F.coalesce(text, F.lit("")))
    return F.array_remove(F.split(lowered, r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), "")


def _small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def benchmark_items(benchmark: DataFrame, *, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """(item, words, ids): one row per distinct word sequence, with the ids of the items that have it."""
    rows = benchmark.select(F.coalesce(F.col(item_id).cast("string"), F.lit("")).alias("id"), index_words(F.col(text)).alias("words"))
    named = rows.where(F.size("words") > 0).withColumn("item", F.md5(F.array_join("words", " ")))
    return named.groupBy("item").agg(F.first("words").alias("words"), F.collect_set("id").alias("ids"))


def item_windows(items: DataFrame, window: int) -> DataFrame:
    """(item, start, at, term): the terms of every window of every item."""
    starts = F.sequence(F.lit(0), F.greatest(F.size("words") - window, F.lit(0)))
    opened = items.select("item", "words", F.explode(starts).alias("start"))
    placed = opened.select("item", "start", F.posexplode(F.slice("words", F.col("start") + 1, window)).alias("j", "term"))
    return placed.select("item", "start", (F.col("start") + F.col("j")).alias("at"), "term")


def term_counts(docs: DataFrame, terms: DataFrame, text: str) -> DataFrame:
    """(term, n): occurrences in all documents. Few terms pick their tokens first; many wait until the tokens are counted."""
    tokens = docs.select(F.explode(index_words(F.col(text))).alias("term"))
    if terms.count() <= BROADCAST_ROWS:
        counted = tokens.join(F.broadcast(terms), "term").groupBy("term").count()
    else:
        counted = tokens.groupBy("term").count().join(terms, "term")
    return counted.withColumnRenamed("count", "n")


def segments(items: DataFrame, windows: DataFrame, counts: DataFrame, window: int) -> DataFrame:
    """(seg, words, ids, term_1, off_1, seconds): the segments of all items whose windows can occur.

    term_1 at off_1 is the rarest term of each of the segment's windows, the first of equals; seconds are the windows' second rarest, (term, off),
    none in windows of one word.
    """
    ranked = (
        windows.join(counts, "term", "left")
        .groupBy("item", "start")
        .agg(F.slice(F.sort_array(F.collect_list(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "at", "term"))), 1, 2).alias("r"))
        .where(F.col("r")[0]["n"] > 0)
    )
    runs = ranked.groupBy("item", F.col("r")[0]["at"].alias("at")).agg(
        F.min("start").alias("first"), F.max("start").alias("last"), F.first(F.col("r")[0]["term"]).alias("term_1"), F.collect_set(F.get("r", F.lit(1))).alias("others")
    )
    words = F.slice("words", F.col("first") + 1, F.col("last") - F.col("first") + window)
    seconds = F.array_sort(F.transform("others", lambda o: F.struct(o["term"].alias("term"), (o["at"] - F.col("first")).alias("off"))))
    cut = runs.join(items, "item").select(words.alias("words"), "ids", "term_1", (F.col("at") - F.col("first")).alias("off_1"), seconds.alias("seconds"))
    same = F.md5(F.concat_ws(" ", F.col("off_1").cast("string"), F.array_join("words", " ")))
    first = [F.first(c).alias(c) for c in ("words", "term_1", "off_1", "seconds")]
    return cut.groupBy(same.alias("seg")).agg(*first, F.array_distinct(F.flatten(F.collect_list("ids"))).alias("ids"))


def build_index(docs: DataFrame, terms: DataFrame, *, key: str, text: str) -> DataFrame:
    """The stored index (term, doc_id, pos) of ``terms(term)``."""
    placed = docs.select(F.col(key).alias("doc_id"), F.posexplode(index_words(F.col(text))).alias("pos", "term"))
    return written(placed.join(_small(terms), "term").select("term", "doc_id", "pos"), "postings")


def candidates(postings: DataFrame, anchors: DataFrame) -> DataFrame:
    """(seg, doc_id, start): where the rarest two lists of some window of a segment agree; anchors(seg, term_1, off_1, term_2, off_2)."""
    first = postings.join(_small(anchors.withColumnRenamed("term_1", "term")), "term")
    lines = first.select("seg", "doc_id", (F.col("pos") - F.col("off_1")).alias("start"), "term_2", (F.col("pos") - F.col("off_1") + F.col("off_2")).alias("pos_2"))
    other = postings.select(F.col("term").alias("_term"), F.col("doc_id").alias("_doc"), F.col("pos").alias("_pos"))
    agreed = lines.where("term_2 IS NOT NULL").join(
        other, (F.col("term_2") == F.col("_term")) & F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("pos_2") == F.col("_pos")), "left_semi"
    )
    alone = lines.where("term_2 IS NULL")
    return agreed.union(alone).select("seg", "doc_id", "start").distinct()


def near_matches(postings: DataFrame, pairs: DataFrame, slop: int) -> DataFrame:
    """(pair, doc_id, pos_1, pos_2): both terms of ``pairs(pair, term_1, term_2)`` at most ``slop`` words apart.

    Positions meet in strips of slop + 1 words, so a document's occurrences are not all paired.
    """
    strip = lambda c: F.floor(F.col(c) / (slop + 1))
    left = postings.join(_small(pairs.withColumnRenamed("term_1", "term")), "term").select("pair", "doc_id", F.col("pos").alias("pos_1"), "term_2")
    left = left.withColumn("strip", F.explode(F.array(strip("pos_1") - 1, strip("pos_1"), strip("pos_1") + 1)))
    right = postings.select(F.col("term").alias("term_2"), "doc_id", F.col("pos").alias("pos_2"), strip("pos").alias("strip"))
    met = left.join(right, ["term_2", "doc_id", "strip"]).where(F.abs(F.col("pos_1") - F.col("pos_2")) <= slop)
    return met.where("NOT (pos_1 = pos_2)").select("pair", "doc_id", "pos_1", "pos_2").distinct()


def _matches(words: Column, lines: Column, window: int) -> Column:
    """Per segment, (ids, spans): the spans (start, length) of its windows that the document repeats exactly."""

    def of(line: Column) -> Column:
        length = F.least(F.size(line["words"]), F.lit(window))
        inside = F.sequence(F.lit(0), F.size(line["words"]) - length)
        same = lambda s, p: (p + s >= 0) & (F.slice(words, F.greatest(p + s, F.lit(0)) + 1, length) == F.slice(line["words"], s + 1, length))
        here = F.flatten(F.transform(inside, lambda s: F.transform(F.filter(line["starts"], lambda p: same(s, p)), lambda p: F.struct((p + s).alias("at"), length.alias("n")))))
        return F.struct(line["ids"].alias("ids"), here.alias("spans"))

    return F.filter(F.transform(F.coalesce(lines, F.array().cast("array<struct<words:array<string>,ids:array<string>,starts:array<int>>>")), of), lambda m: F.size(m["spans"]) > 0)


def contamination(docs: DataFrame, benchmark: DataFrame, *, window: int = 10, key: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """(doc_id, n_words, n_hit, items) for every row of docs; items are the ids of the items with matching windows, sorted as strings."""
    items = written(benchmark_items(benchmark, item_id=item_id, text=item_text), "benchmark-items")
    windows = item_windows(items, window)
    counts = term_counts(docs, windows.select("term").distinct(), text)
    cut = written(segments(items, windows, counts, window), "segments")
    opened = cut.select("seg", "term_1", "off_1", F.explode_outer("seconds").alias("s"))
    anchors = opened.select("seg", "term_1", "off_1", F.col("s.term").alias("term_2"), F.col("s.off").alias("off_2"))
    terms = anchors.select(F.explode(F.array("term_1", "term_2")).alias("term")).where("term IS NOT NULL").distinct()
    postings = build_index(docs, terms, key=key, text=text)
    starts = candidates(postings, anchors).groupBy("doc_id", "seg").agg(F.collect_list(F.col("start").cast("int")).alias("starts"))
    lines = starts.join(cut.select("seg", "words", "ids"), "seg")
    by_doc = lines.groupBy(F.col("doc_id").alias("_doc")).agg(F.collect_list(F.struct("words", "ids", "starts")).alias("lines"))
    rows = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"))
    joined = rows.join(by_doc, rows.doc_id.eqNullSafe(F.col("_doc")), "left")
    judged = joined.select("doc_id", index_words(F.col("text")).alias("words"), "lines")
    judged = judged.select("doc_id", F.size("words").cast("long").alias("n_words"), _matches(F.col("words"), F.col("lines"), window).alias("matches"))
    spans = F.flatten(F.transform("matches", lambda m: m["spans"]))
    places = F.array_distinct(F.flatten(F.transform(spans, lambda s: F.sequence(s["at"], s["at"] + s["n"] - 1))))
    ids = F.array_sort(F.array_distinct(F.flatten(F.transform("matches", lambda m: m["ids"]))))
    return judged.select("doc_id", "n_words", F.size(places).cast("long").alias("n_hit"), ids.alias("items"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, *, window: int = 10, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents without any benchmark window, with all their columns."""
    hit = contamination(docs, benchmark, window=window, key=key, text=text).where("n_hit > 0").select(F.col("doc_id").alias("hit")).distinct()
    return docs.alias("_docs").join(hit.alias("_found"), F.col(f"_docs.{key}").eqNullSafe(F.col("_found.hit")), "left_anti")
