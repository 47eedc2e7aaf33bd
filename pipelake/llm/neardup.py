r"""Near-duplicate documents by bottom-k sketches of word shingles.

1. Each text becomes the set of its word shingles, hashed by one function. The k smallest hashes,
   in order, are its sketch; a digest of the whole set names its class. Equal sets are one class from here on.
2. Inverted lists of retained values: the key of a list is a run of consecutive sketch values. Two sets with Jaccard similarity s
   keep a value of their common sketch both with probability s; at 0.8 the chance that 80 values hold no common run of four is
   2e-8. In sets that fit their sketch it cannot happen: u unshared values cannot cut the others into pieces
   shorter than four, or three for up to 16 values, or two for up to five, and so short sets use shorter runs too.
3. Each list has a leader, and a member meets the leader that most of its lists have, which settles groups of copies in linear
   work: a group of n near copies costs n pairs a round. A list whose members are then of one component is done with.
4. Members of lists that stay open (a passage that many unlike documents share opens such lists) meet by their rarest values, on
   their full sets. A set offers only as many of its values as it may hold beyond what a partner must share with it. Values of one
   component alone count as offered, so what is edited too far for any link offers nothing, and what all share joins nobody.
   A large group of copies shares nearly all its values, so its members meet by what tells them from one set amid the group, their pivot.
   One link joins two components, whatever else they share: of the pairs of two components a few are confirmed at first, then more, then all
   that are left, and pairs whose components have met by then are done with.
5. The union sketch of a pair estimates its similarity; pairs six deviations below the limit go (at 0.8, 3e-8 of the pairs). What is left is confirmed on the full sets.

Words are ``[^\x20\x09-\x0D]+`` after lower-casing A-Z. A text of fewer words than a shingle has is one shingle; a text
without words (or null) is linked with nothing. Rows with a null id are never linked and are kept. Equal rows
share their class. Extra columns pass through ``deduplicate`` unchanged.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pipelake.llm.common import let, written
from pipelake.llm.graph import components
from pipelake.llm.hashing import WordHashes, mixed

#: Run lengths, each with the largest set that needs it; larger sets use the last alone.
RUNS = ((2, 5), (3, 16), (4, None))
#: Full sets up to this size, longer sketches above it, where lists stay open after the leader rounds.
MOST = 2048
#: Pairs of two components that are confirmed at a time; the last time it is all.
WAVES = (4, 32, None)
#: Bands of set sizes there, as a step of the logarithm.
BAND = 0.02
#: A set has a pivot if it is at most so many times as far from it as a link may be.
REACH = 4


def shingle_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Sorted distinct hashes of the shingles of ``size`` words."""
    size = min(size, len(words))
    if not size:
        return words
    n = len(words) - size + 1
    value = np.full(n, size, np.uint64)
    for j in range(size):
        value = mixed(value + words[j : j + n])
    return np.unique(value)


def shingle_set(text: str | None, size: int) -> set[tuple[bytes, ...]]:
    """The shingles themselves, for the exact check."""
    words = text.encode().lower().split() if text else []
    size = min(size, len(words))
    return set(zip(*(words[j:] for j in range(size)), strict=False)) if size else set()


def sketches(docs: DataFrame, *, size: int, k: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_shingles, digest, sketch) of every row; no digest where there is no shingle."""

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            counts, digests, values = [], [], []
            for value in batch.column(1):
                raw = value.as_py()
                found = shingle_hashes(hashes.of(raw.encode().lower().split() if raw else []), size)
                counts.append(len(found))
                digests.append(xxhash.xxh3_128_digest(found.tobytes()) if len(found) else None)
                values.append(found[:k].view(np.int64))
            offsets = np.concatenate(([0], np.cumsum([len(v) for v in values]))).astype(np.int32)
            flat = np.concatenate(values) if values else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(counts, pa.int64()), pa.array(digests, pa.binary()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, pa.int64()))],
                names=["doc_id", "n_shingles", "digest", "sketch"],
            )

    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(
        sketch, "doc_id long, n_shingles long, digest binary, sketch array<long>"
    )


def _runs(length: int):
    """Hashes of the runs of ``length`` consecutive sketch values."""
    starts = F.sequence(F.lit(1), F.size("sketch") - (length - 1))
    return F.when(
        F.size("sketch") >= length,
        F.transform(starts, lambda i: F.xxhash64(F.lit(length), *[F.get("sketch", i + (j - 1)) for j in range(length)])),
    ).otherwise(F.array().cast("array<long>"))


def inverted_lists(classes: DataFrame) -> DataFrame:
    """(key, node, n) for keys that two classes or more share."""
    keys = _runs(RUNS[-1][0])
    for length, most in RUNS[:-1]:
        keys = F.when(F.col("n") <= most, F.concat(keys, _runs(length))).otherwise(keys)
    postings = classes.select(F.explode(F.array_distinct(keys)).alias("key"), "node", "n")
    shared = postings.groupBy("key").count().where("count > 1").select("key")
    return postings.join(shared, "key")


def _sizes_fit(percent: int):
    return F.lit(100) * F.least("n_a", "n_b") >= F.lit(percent) * F.greatest("n_a", "n_b")


def _least_common(percent: int, k: int) -> float:
    """Share of the union sketch that a linked pair has in common, six deviations below the limit."""
    limit = percent / 100
    return limit - 6 * (limit * (1 - limit) / k) ** 0.5


def _common(percent: int):
    """Least number of values that linked sets of n_a and n_b shingles have in common."""
    return F.lit(percent) * (F.col("n_a") + F.col("n_b")) / F.lit(100 + percent)


def around_pivots(sets: DataFrame, percent: int, most: int) -> tuple[DataFrame, DataFrame]:
    """(sets, pairs) of sets(node, n, c, held, pivot): pairs(a, b, n_a, n_b) of one pivot and different components, and the sets, those without a near pivot as their own.

    A set is told from its pivot L by the values that it lacks and those that it has besides. With w = 100 lacking + percent besides, two sets reach the
    similarity just if their differences share r = (w_a + w_b - far) / (100 + percent) values, where far = (100 - percent) n_L; that holds for any L.
    Sets with w <= far are linked with L, so each of them meets L and no other such set. Of any other pair one set is beyond far, and r exceeds w / (100 + percent) of the
    other, which is about half of its differences: copies with edits of their own share too few and offer nothing, however large the group.
    Differences of one component alone count as offered; the others go rarest first, as in ``by_rare_values``.
    """
    whole = F.lit(100) * F.col("n") <= F.lit(percent * most)
    base = sets.where(whole).select(F.col("node").alias("pivot"), F.col("c").alias("c_l"), F.col("n").alias("n_l"), F.col("held").alias("base"))
    told = sets.join(base, "pivot", "left").withColumns({"lacks": F.array_except("base", "held"), "besides": F.array_except("held", "base")})
    told = told.withColumns({"w": F.lit(100) * F.size("lacks") + F.lit(percent) * F.size("besides"), "far": F.lit(100 - percent) * F.col("n_l")})
    near = F.coalesce(whole & F.col("base").isNotNull() & (F.col("w") <= F.lit(REACH) * F.col("far")), F.lit(False))
    told = told.select("node", "n", "c", "held", F.when(near, F.col("pivot")).otherwise(F.col("node")).alias("pivot"), "c_l", "n_l", "w", "far", F.when(near, F.concat("lacks", "besides")).alias("told"))
    told = written(told, "told")
    stars = told.where("told IS NOT NULL AND w <= far AND c <> c_l").select(F.least("node", "pivot").alias("a"), F.greatest("node", "pivot").alias("b"), F.col("n").alias("n_a"), F.col("n_l").alias("n_b"))
    values = told.select("pivot", "node", "c", F.explode("told").alias("value"))
    met = values.groupBy("pivot", "value").agg(F.count("*").alias("df"), F.min("c").alias("low"), F.max("c").alias("high")).where("low < high").select("pivot", "value", "df")
    ranked = values.join(met, ["pivot", "value"]).groupBy("node").agg(F.sort_array(F.collect_list(F.struct("df", "value"))).alias("r"))
    ranked = written(ranked.join(told.select("node", "n", "c", "pivot", "w", "far"), "node"), "ranked")
    scale = F.lit(100 + percent)
    more = F.floor(F.col("w") / scale) + 1
    some = F.greatest(F.lit(1), F.ceil((F.col("w") - F.col("far")) / scale))
    offer = lambda rows, both, least: rows.select("node", "n", "c", "w", "far", "pivot", F.lit(both).alias("both"), F.explode(F.transform(F.slice("r", 1, F.greatest(F.lit(0), F.size("r") - least.cast("int") + 1)), lambda x, i: F.struct(x["value"].alias("value"), (F.size("r") - i).alias("rest")))).alias("o"))
    inside, beyond = ranked.where("w <= far"), ranked.where("w > far")
    side = lambda rows, x: rows.select("pivot", "both", "o.value", F.col("node").alias(x), *[F.col(k).alias(f"{k}_{x}") for k in ("n", "c", "w")], F.col("o.rest").alias(f"rest_{x}"), *(["far"] if x == "a" else []))
    found = side(offer(inside, False, more).union(offer(beyond, True, more)), "a").join(side(offer(beyond, False, some).union(offer(beyond, True, more)), "b"), ["pivot", "both", "value"])
    enough = scale * F.least("rest_a", "rest_b") >= F.col("w_a") + F.col("w_b") - F.col("far")
    found = found.where((F.col("c_a") != F.col("c_b")) & (~F.col("both") | (F.col("a") < F.col("b"))) & _sizes_fit(percent) & enough)
    pairs = found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), F.least("n_a", "n_b").alias("n_a"), F.greatest("n_a", "n_b").alias("n_b"))
    return told.select("node", "n", "c", "held", "pivot"), stars.union(pairs)


def by_rare_values(open_nodes: DataFrame, members: DataFrame, *, size: int, percent: int, most: int = MOST) -> DataFrame:
    """(a, b, n_a, n_b) of open nodes(node, n, c[, pivot]) of different components that may have enough values in common.

    It works on the full sets of shingle hashes (above ``most`` values on longer sketches). Pairs of one pivot come from ``around_pivots``, the others are met here.
    A value that one component or the sets of one pivot alone
    hold is common to no pair asked for, so it comes first in the order of values; the others follow, rarest first. Two sets with t
    values in common share one whose rest of the order, itself included, holds t values or more in both sets. So each set offers
    only the values before its last t, and one with too many values of its own offers none: the edited copies of a text that are
    each too far from the next leave here, at a cost linear in their number. t depends on both sizes: the smaller set of a pair offers its
    values under the band of its size, the larger one under each band of sizes that may be linked with it.
    """
    sets = sketches(members.join(open_nodes.select("node"), "node", "left_semi"), size=size, k=most, key="node").select(F.col("doc_id").alias("node"), F.col("sketch").alias("held"))
    sets = written(open_nodes.join(sets, "node"), "sets")
    amid = None
    if "pivot" in open_nodes.columns:
        sets, amid = around_pivots(sets, percent, most)
    else:
        sets = sets.withColumn("pivot", F.col("node"))
    nodes = sets.select("node", "n", "c", "pivot")
    values = sets.select("node", "c", "pivot", F.explode("held").alias("value"))
    ends = [f(x).alias(f"{name}_{x}") for x in ("c", "pivot") for f, name in ((F.min, "low"), (F.max, "high"))]
    met = values.groupBy("value").agg(F.count("*").alias("df"), *ends).where("low_c < high_c AND low_pivot < high_pivot").select("value", "df")
    ranked = values.join(met, "value").groupBy("node").agg(F.sort_array(F.collect_list(F.struct("df", "value"))).alias("r"))
    ranked = ranked.join(nodes, "node")
    # Where a set of the pair may be a sketch, the common values are those of the union sketch.
    sampled = F.lit(_least_common(percent, most) * most)
    least = lambda other: let(F.lit(percent) * (F.col("n") + other) / F.lit(100 + percent), lambda t: F.when(F.lit(100) * F.col("n") > F.lit(percent * most), F.least(t, sampled)).otherwise(t))
    band = lambda n: F.floor(F.log(n) / F.lit(BAND)).cast("int")
    low = lambda s: F.floor(F.exp(s * F.lit(BAND)) - F.lit(1e-6))
    offer = lambda s, t: F.transform(F.slice("r", 1, F.greatest(F.lit(0), F.size("r") - F.ceil(t - F.lit(1e-6)).cast("int") + 1)), lambda x, i: F.struct(s.alias("band"), x["value"].alias("value"), (F.size("r") - i).alias("rest")))
    smaller = ranked.select("node", "n", "c", "pivot", F.explode(offer(band(F.col("n")), least(F.col("n")))).alias("o"))
    bands = ranked.select("*", F.explode(F.sequence(band(F.greatest(F.lit(1), F.floor(F.col("n") * percent / 100))), band(F.col("n")))).alias("s"))
    larger = bands.select("node", "n", "c", "pivot", F.explode(offer(F.col("s"), least(low(F.col("s"))))).alias("o"))
    side = lambda rows, x: rows.select("o.band", "o.value", F.col("node").alias(x), F.col("n").alias(f"n_{x}"), F.col("c").alias(f"c_{x}"), F.col("pivot").alias(f"pivot_{x}"), F.col("o.rest").alias(f"rest_{x}"))
    both = F.when(F.lit(100) * F.col("n_b") > F.lit(percent * most), F.least(_common(percent), sampled)).otherwise(_common(percent))
    ordered = (F.col("n_a") < F.col("n_b")) | ((F.col("n_a") == F.col("n_b")) & (F.col("a") < F.col("b")))
    found = side(smaller, "a").join(side(larger, "b"), ["band", "value"])
    found = found.where(ordered & (F.col("c_a") != F.col("c_b")) & (F.col("pivot_a") != F.col("pivot_b")) & _sizes_fit(percent) & (F.least("rest_a", "rest_b") >= both - F.lit(1e-6)))
    pairs = found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), F.least("n_a", "n_b").alias("n_a"), F.greatest("n_a", "n_b").alias("n_b"))
    return pairs if amid is None else pairs.union(amid)


def _centrality(turn: int):
    """How central a node of w lists is: edits take a copy out of lists, so what a group was copied from has the most. Later turns try others near it."""
    spread = 0.0 if turn < 2 else 0.3
    return F.col("w") * (1 - spread * F.pmod(F.xxhash64("node", F.lit(turn)), F.lit(1024)) / 1024)


def by_leader(open_lists: DataFrame, percent: int) -> DataFrame:
    """(a, b, n_a, n_b): each node of another component with the one leader that most of its lists have: one pair a node."""
    met = open_lists.where("c <> lead.c").select("node", "n", F.col("lead.node").alias("lead"), F.col("lead.n").alias("lead_n"))
    met = met.where(F.lit(100) * F.least("n", "lead_n") >= F.lit(percent) * F.greatest("n", "lead_n"))
    counted = met.groupBy("node", "n", "lead", "lead_n").count()
    chosen = counted.groupBy("node", "n").agg(F.max_by(F.struct("lead", "lead_n"), F.struct("count", "lead")).alias("l"))
    return chosen.select(F.least("node", "l.lead").alias("a"), F.greatest("node", "l.lead").alias("b"), F.col("n").alias("n_a"), F.col("l.lead_n").alias("n_b"))


def pivots(open_lists: DataFrame) -> DataFrame:
    """(node, n, c, pivot) of the open nodes: the leader that most of a node's lists have, whatever its component."""
    counted = open_lists.groupBy("node", "n", "c", F.col("lead.node").alias("lead")).count()
    return counted.groupBy("node", "n", "c").agg(F.max_by("lead", F.struct("count", "lead")).alias("pivot"))


def confirm(pairs: DataFrame, members: DataFrame, *, size: int, percent: int, k: int) -> DataFrame:
    """The (a, b) of ``pairs`` whose full shingle sets reach the similarity.

    ``members(node, sketch, text)`` holds each class once. A pair goes on to the full sets unless its union
    sketch puts it more than six deviations below the limit.
    """
    floor = _least_common(percent, k)

    def estimate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for one, two in zip(batch.column(2), batch.column(3), strict=True):
                one, two = (x.values.to_numpy().view(np.uint64) for x in (one, two))
                union = np.union1d(one, two)[:k]
                common = np.intersect1d(one, two, assume_unique=True)
                keep.append(np.searchsorted(common, union[-1], side="right") >= floor * len(union))
            yield batch.filter(pa.array(keep, pa.bool_())).select(["a", "b"])

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple = (None, set())
        for batch in batches:
            keep = []
            for a, one, two in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                if last[0] != a:
                    last = (a, shingle_set(one, size))
                other = shingle_set(two, size)
                common = len(last[1] & other)
                keep.append(common > 0 and 100 * common >= percent * (len(last[1]) + len(other) - common))
            yield batch.filter(pa.array(keep, pa.bool_())).select(["a", "b"])

    def both(rows: DataFrame, column: str) -> DataFrame:
        side = lambda c: members.select(F.col("node").alias(c), F.col(column).alias(f"_{c}"))
        return rows.join(side("a"), "a").join(side("b"), "b").select("a", "b", "_a", "_b")

    likely = both(pairs, "sketch").mapInArrow(estimate, "a long, b long")
    return both(likely, "text").mapInArrow(check, "a long, b long")


def _settled(pairs: DataFrame, links: DataFrame | None, owner: DataFrame | None, members: DataFrame, **how) -> tuple[DataFrame | None, DataFrame | None]:
    """(links, owner) after all pairs(a, b): each is confirmed, unless its ends are of one component by the time it is its turn."""
    left = written(pairs, "pairs")
    for width in WAVES:
        now = left
        for end in ("a", "b"):
            now = now.withColumn(f"c_{end}", F.col(end)) if owner is None else now.join(owner.select(F.col("node").alias(end), F.col("component").alias("c")), end, "left").withColumn(f"c_{end}", F.coalesce("c", end)).drop("c")
        left = written(now.where("c_a <> c_b").select("a", "b", "c_a", "c_b"), "pairs")
        if left.isEmpty():
            break
        here = left.select("a", "b")
        if width is not None:
            between = Window.partitionBy(F.least("c_a", "c_b"), F.greatest("c_a", "c_b")).orderBy(F.xxhash64("a", "b"), "a", "b")
            here = written(left.withColumn("turn", F.row_number().over(between)).where(F.col("turn") <= width).select("a", "b"), "wave")
        fresh = written(confirm(here, members, **how), "links")
        links = fresh if links is None else links.union(fresh)
        if not fresh.isEmpty():
            owner = written(components(links), "owners")
        if width is None or here.count() == left.count():
            break
        left = left.select("a", "b").join(here, ["a", "b"], "left_anti")
    return links, owner


def near_duplicates(docs: DataFrame, *, size: int = 5, percent: int = 80, k: int = 80, rounds: int = 3, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of docs.

    ``rounds`` is the number of leader rounds; what they leave open meets by rare values.
    """
    found = written(sketches(docs, size=size, k=k, key=key, text=text), "sketches")
    classes = (
        found.where("digest IS NOT NULL AND doc_id IS NOT NULL")
        .groupBy("digest")
        .agg(F.min("doc_id").alias("node"), F.max("n_shingles").alias("n"))
    )
    heads = written(classes, "classes")
    drawn = found.join(heads.select("digest", "node", "n"), "digest").where("doc_id = node").dropDuplicates(["digest"])
    lists = written(inverted_lists(drawn.select("node", "n", "sketch")), "lists")
    listed = lists.select(F.col("node").alias("doc_id")).distinct()
    texts = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")).join(listed, "doc_id", "left_semi")
    members = texts.dropDuplicates(["doc_id"]).join(found.select("doc_id", "sketch").dropDuplicates(["doc_id"]), "doc_id")
    members = written(members.select(F.col("doc_id").alias("node"), "sketch", "text"), "members")

    links, owner = None, None
    for turn in range(rounds + 1):
        here = lists.withColumn("w", F.count("*").over(Window.partitionBy("node"))) if turn else lists.withColumn("w", F.lit(1))
        here = here.withColumn("c", F.col("node")) if owner is None else here.join(owner, "node", "left").withColumn("c", F.coalesce("component", "node")).drop("component")
        lead = F.max_by(F.struct("node", "n", "c"), F.struct(_centrality(turn if turn < rounds else 1), F.xxhash64("node", F.lit(turn))))
        ends = here.groupBy("key").agg(F.min("c").alias("low"), F.max("c").alias("high"), lead.alias("lead")).where("low < high").select("key", "lead")
        open_lists = here.join(ends, "key")
        if turn < rounds:
            pairs = by_leader(open_lists, percent)
        else:
            pairs = by_rare_values(written(pivots(open_lists), "open"), members, size=size, percent=percent)
        pairs = pairs.where(_sizes_fit(percent)).select("a", "b").distinct()
        if turn == rounds:
            links, owner = _settled(pairs, links, owner, members, size=size, percent=percent, k=k)
            break
        fresh = written(confirm(pairs, members, size=size, percent=percent, k=k), "links")
        links = fresh if links is None else links.union(fresh)
        if not fresh.isEmpty():
            owner = written(components(links), "owners")
        lists = written(open_lists.select("key", "node", "n"), "lists")
        if lists.isEmpty():
            break
    label = heads.select("digest", "node")
    if owner is not None:
        label = label.join(owner, "node", "left").select("digest", F.coalesce("component", "node").alias("component"))
    else:
        label = label.select("digest", F.col("node").alias("component"))
    placed = found.select("doc_id", "n_shingles", "digest").join(label, "digest", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return placed.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"))


def deduplicate(docs: DataFrame, *, size: int = 5, percent: int = 80, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents of docs that stand for their group, with all their columns; of repeated rows all stay or none."""
    verdict = near_duplicates(docs, size=size, percent=percent, key=key, text=text)
    gone = verdict.where("NOT kept").select(F.col("doc_id").alias(key)).distinct()
    return docs.join(gone, key, "left_anti")
