r"""Merkle manifest of a dataset, with nested-interval labels.

Every row is a leaf. Per group (a null value is a group too) leaves ascend by key, nulls first; equal keys go by leaf, so repeated rows
have a defined place. Every ``fanout`` consecutive nodes (the last run may be shorter, even one) have their digest as parent, until one node, the
group's subroot, is left; a lone leaf is its own subroot. Subroots ordered by group (null first, then bytewise) have a root in the same way. A
digest is the lowercase hex sha256 of its inputs, concatenated.

A node is labelled with the interval [lo, hi) of the leaf ranks it covers. Nodes of one level meet their parent in a join on
(group, bucket), bucket being lo div the parent level's width, and containment of the intervals. What a parent's interval has before and after a
child's own are the child's left and right siblings. Paths of siblings come down from the root, level by level: a join per level, each
eight times smaller than the one below it, and only the last has a row per eight leaves.

Leaf ranks come from a range sort (group, key, leaf, then a salt, so that equal rows spread) and the counts of the sorted parts; no group
passes through one task. Nulls in any column have a leaf form of their own (``-``). An empty table gives an empty manifest.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pipelake.llm.common import written

FANOUT = 8


def digest(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts), 256)


def leaf_digest(columns: list[Column]) -> Column:
    """Digest of a row: each value as its UTF-8 byte count, a colon and itself, or ``-``."""
    texts = [c.cast("string") for c in columns]
    return digest(*[F.when(t.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t)) for t in texts])


def fold(start: Column, path: Column) -> Column:
    """The root that a node's digest and its path of (left, right) siblings give."""
    return F.aggregate(path, start, lambda acc, x: digest(x["left"], acc, x["right"]))


def siblings_digest(path: Column) -> Column:
    """One digest of all siblings of a path, level by level, left to right."""
    return F.sha2(F.array_join(F.transform(path, lambda x: F.concat(x["left"], x["right"])), ""), 256)


@dataclass
class Manifest:
    """Leaves have the columns grp, lo, leaf and carried, subroot, root and path: an array of (left, right) from the leaf up."""

    leaves: DataFrame
    subroots: DataFrame


def _ranked(nodes: DataFrame, order: list[str]) -> DataFrame:
    """nodes with lo (rank in its grp) and size (nodes of its grp)."""
    keys = [F.asc_nulls_first(c) for c in ["grp", *order]]
    salted = nodes.withColumn("salt", F.rand(11))
    placed = salted.repartitionByRange(*keys, "salt").sortWithinPartitions(*keys).drop("salt").withColumn("at", F.monotonically_increasing_id())
    placed = written(placed.withColumn("part", F.shiftright("at", 33)), "ranked-nodes")
    counts = placed.groupBy(F.col("grp").alias("g"), F.col("part").alias("p")).agg(F.min("at").alias("first"), F.count("*").alias("n"))
    over = Window.partitionBy("g")
    before = F.coalesce(F.sum("n").over(over.orderBy("p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select("g", "p", (before - F.col("first")).alias("shift"), F.sum("n").over(over).alias("size"))
    met = placed.join(starts, F.col("grp").eqNullSafe(F.col("g")) & (F.col("part") == F.col("p")))
    return met.withColumn("lo", F.col("at") + F.col("shift")).drop("at", "part", "g", "p", "shift")


def _tree(nodes: DataFrame, carried: list[str]) -> tuple[list[DataFrame], list[DataFrame]]:
    """Runs of each level (grp, bucket, size, kids), from the leaves up, and the last nodes (grp, digest) of the groups that end at each level.

    nodes has grp, lo, size, digest and the carried columns; those stay with the kids of the lowest level.
    """
    runs, tops, width = [], [], 1
    level = nodes.select("grp", "size", F.struct("lo", (F.col("lo") + 1).alias("hi"), "digest", *carried).alias("kid"))
    while True:
        bucket = F.expr(f"kid.lo DIV {width * FANOUT}").alias("bucket")
        run = written(level.groupBy("grp", bucket, "size").agg(F.sort_array(F.collect_list("kid")).alias("kids")), "merkle-runs")
        if run.isEmpty():
            return runs, tops
        runs.append(run)
        own = F.when(F.col("size") == 1, F.col("kids")[0]["digest"]).otherwise(F.sha2(F.array_join(F.col("kids.digest"), ""), 256))
        lo, hi = F.col("kids")[0]["lo"].alias("lo"), F.element_at("kids", -1)["hi"].alias("hi")
        parents = run.select("grp", "size", F.struct(lo, hi, own.alias("digest")).alias("kid"))
        done = F.col("kid.hi") - F.col("kid.lo") == F.col("size")
        tops.append(parents.where(done).select("grp", F.col("kid.digest").alias("digest")))
        level, width = parents.where(~done), width * FANOUT


def _paths(runs: list[DataFrame], tops: list[DataFrame], carried: list[str], kept: list[str]) -> DataFrame:
    """The lowest nodes (grp, digest, carried, path, kept): tops[k] has (grp, path, kept) of the groups that end at level k."""
    siblings = "array<struct<left:string,right:string>>"
    below = None
    for k in range(len(runs) - 1, -1, -1):
        width = FANOUT ** (k + 1)
        # The parents of this level's runs: last nodes of their group, and nodes that the level above has opened.
        parents = tops[k].select("grp", F.lit(0).cast("long").alias("p_lo"), F.lit((1 << 63) - 1).alias("p_hi"), "path", *kept)
        if below is not None:
            parents = parents.union(below.select("grp", "lo", "hi", "path", *kept))
        parents = parents.select(F.col("grp").alias("g"), F.expr(f"p_lo DIV {width}").alias("b"), "p_lo", "p_hi", "path", *kept)
        inside = (F.col("kids")[0]["lo"] >= F.col("p_lo")) & (F.element_at("kids", -1)["hi"] <= F.col("p_hi"))
        met = runs[k].join(parents, F.col("grp").eqNullSafe(F.col("g")) & (F.col("bucket") == F.col("b")) & inside)
        opened = met.select("grp", "size", "kids", "path", *kept, F.explode("kids").alias("kid"))
        text = lambda x: F.array_join(F.transform(x, lambda y: y["digest"]), "")
        left = text(F.filter("kids", lambda x: x["hi"] <= F.col("kid.lo")))
        right = text(F.filter("kids", lambda x: x["lo"] >= F.col("kid.hi")))
        here = F.array(F.struct(left.alias("left"), right.alias("right"))).cast(siblings)
        path = F.when(F.col("size") == 1, F.col("path")).otherwise(F.concat(here, F.col("path")))
        more = [F.col(f"kid.{c}").alias(c) for c in (carried if k == 0 else [])]
        below = opened.select("grp", F.col("kid.lo").alias("lo"), F.col("kid.hi").alias("hi"), F.col("kid.digest").alias("digest"), *more, path.alias("path"), *kept)
    return below


def build(docs: DataFrame, *, key: str = "doc_id", group: str = "lang", columns: list[str], carry: dict[str, Column] | None = None) -> Manifest:
    """The manifest of docs; a leaf covers ``columns`` in their order. ``carry`` names further columns that stay with the leaves."""
    carry = carry or {}
    names = ["key", *carry]
    own = docs.select(F.col(group).cast("string").alias("grp"), F.col(key).alias("key"), *[c.alias(n) for n, c in carry.items()], leaf_digest([F.col(c) for c in columns]).alias("digest"))
    ranked = _ranked(written(own, "leaves"), ["key", "digest"])
    runs, tops = _tree(ranked, names)
    if not runs:
        empty = own.select("grp", F.lit(0).cast("long").alias("lo"), F.col("digest").alias("leaf"), *names)
        path = F.array().cast("array<struct<left:string,right:string>>")
        nothing = empty.select("*", F.lit("").alias("subroot"), F.lit("").alias("root"), path.alias("path")).limit(0)
        return Manifest(nothing, nothing.select("grp", "subroot", "root", "path"))

    ended = [t.withColumn("level", F.lit(k)) for k, t in enumerate(tops)]
    subroots = ended[0]
    for t in ended[1:]:
        subroots = subroots.union(t)
    # The same once more, with the groups as leaves of one tree.
    subroots = subroots.select(F.lit("").alias("grp"), F.col("grp").alias("key"), "digest", "level")
    upper_runs, upper_tops = _tree(_ranked(written(subroots, "subroots"), ["key"]), ["key", "level"])
    none = F.array().cast("array<struct<left:string,right:string>>")
    upper = _paths(upper_runs, [t.select("grp", none.alias("path"), F.col("digest").alias("root")) for t in upper_tops], ["key", "level"], ["root"])
    upper = written(upper.select(F.col("key").alias("grp"), "level", F.col("digest").alias("subroot"), "root", "path"), "subroot-paths")
    starts = [upper.where(F.col("level") == k).drop("level") for k in range(len(runs))]
    leaves = _paths(runs, starts, names, ["subroot", "root"])
    return Manifest(leaves.select("grp", "lo", F.col("digest").alias("leaf"), *names, "subroot", "root", "path"), upper.drop("level"))
