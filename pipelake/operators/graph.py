"""Order of steps: queue order, levels, cycles, the plan of a dry run, and budgeted selection."""

from __future__ import annotations

import tempfile
import uuid
from functools import reduce
from itertools import count

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pipelake.functions.exprs import render_command


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; a temporary one where it is unset, as in tests."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        folder = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def declared_links(steps: DataFrame, mode: str = "union") -> tuple[DataFrame, DataFrame]:
    """(edges, needed) for topological, from the steps' previous and next lists.

    union: an edge that either side declares; those that only previous declares stand after the listed next entries. reference: edges are
    the next entries and every previous entry has to be met by one, so a step whose predecessor does not list it is never
    placed.
    """
    following = steps.select("workflow_id", F.col("step_id").alias("src"), F.posexplode("next").alias("dst_pos", "dst"))
    if mode == "reference":
        return following, steps.select("workflow_id", "step_id", F.size("previous").cast("long").alias("needed"))
    before = steps.select("workflow_id", F.explode("previous").alias("src"), F.col("step_id").alias("dst"))
    edges = following.unionByName(before, allowMissingColumns=True).groupBy("workflow_id", "src", "dst").agg(F.min("dst_pos").alias("dst_pos"))
    return edges, edges.groupBy("workflow_id", F.col("dst").alias("step_id")).agg(F.count("*").alias("needed"))


def topological(steps: DataFrame, edges: DataFrame, needed: DataFrame | None = None, max_rounds: int | None = None) -> DataFrame:
    """(workflow_id, step_id, ordinal, level, position) of every step; level and position are null in or behind a cycle.

    steps(workflow_id, step_id, ordinal); edges(workflow_id, src, dst[, dst_pos]), whose unknown ends are ignored;
    needed(workflow_id, step_id, needed), by default the number of a step's distinct predecessors. All workflows go together, one
    round per level. Inside a level steps stand in the order in which a first-in first-out queue would release them: by the position of their last
    predecessor, their place among its successors (dst_pos, if given; those without come last), and their own ordinal.

    A round meets the links with the newest level, adds what they bring (links met, last predecessor, the workflow's count so far) to the
    steps met earlier that still wait, and writes two tables: the links, of which the next round reads only those not met yet, and the next level with
    what waits. Each link is so met once, and later rounds shrink with what is left. Steps that nothing has met yet are not touched. It
    ends when a round releases nothing, or raises where that takes more than max_rounds.
    """
    keys = ["workflow_id", "step_id"]
    known = written(steps.select(*keys, "ordinal"), "steps")
    place = F.col("dst_pos") if "dst_pos" in edges.columns else F.lit(None)
    links = edges.select("workflow_id", "src", "dst", place.cast("int").alias("dst_pos"))
    links = links.groupBy("workflow_id", "src", "dst").agg(F.min("dst_pos").alias("dst_pos")) if needed is None else links
    links = links.join(known.select("workflow_id", F.col("step_id").alias("src")).distinct(), ["workflow_id", "src"], "left_semi")
    target = known.withColumnRenamed("step_id", "dst")
    if needed is not None:
        links = links.join(target, ["workflow_id", "dst"]).join(needed.withColumnRenamed("step_id", "dst"), ["workflow_id", "dst"], "left")
    else:
        links = links.join(target, ["workflow_id", "dst"])
        links = links.withColumn("needed", F.count("*").over(Window.partitionBy("workflow_id", "dst", "ordinal")))
    links = written(links.select("workflow_id", "src", "dst", "dst_pos", "ordinal", F.coalesce("needed", F.lit(0)).cast("long").alias("needed")), "links")
    if needed is None:
        first = known.join(links.select("workflow_id", F.col("dst").alias("step_id")), keys, "left_anti")
    else:
        first = known.join(needed.where("needed > 0"), keys, "left_anti")

    waiting = ["done", "needed", "after", "place", "before"]
    here = first.select(*keys, "ordinal", *[F.lit(0).cast("long").alias(c) for c in ("done", "needed", "after")], F.lit(0).alias("place"), F.lit(0).cast("long").alias("before"))
    parts: list[DataFrame] = []
    for level in count():
        free = F.col("done") >= F.col("needed")
        queue = Window.partitionBy("workflow_id").orderBy(free.desc(), "after", "place", "ordinal", "step_id")
        position = F.when(free, F.col("before") + F.row_number().over(queue))
        so_far = F.max("position").over(Window.partitionBy("workflow_id"))
        here = written(here.withColumn("position", position.cast("long")).withColumn("so_far", so_far).withColumn("level", F.lit(level)), "level")
        newest = here.where("position IS NOT NULL")
        if newest.isEmpty():
            break
        if max_rounds is not None and level >= max_rounds:
            raise RuntimeError(f"steps are left to place after {max_rounds} rounds")
        parts.append(newest.select(*keys, "ordinal", "level", "position"))
        if len(parts) == 16:
            parts = [written(reduce(DataFrame.union, parts), "placed")]
        released = newest.select("workflow_id", F.col("step_id").alias("src"), "position", "so_far")
        # A step row that repeats releases each of its links again, so a link may stand in several rows of met.
        met = written(links.join(released, ["workflow_id", "src"], "left"), "met")
        links = met.where("position IS NULL").drop("position", "so_far")
        brought = met.where("position IS NOT NULL").select(
            "workflow_id", F.col("dst").alias("step_id"), "ordinal", F.lit(1).cast("long").alias("done"), "needed",
            F.col("position").alias("after"), F.coalesce("dst_pos", F.lit((1 << 31) - 1)).alias("place"), F.col("so_far").alias("before"),
        )
        pending = brought.union(here.where("position IS NULL").select(brought.columns))
        last = F.max(F.struct("after", "place"))
        merged = pending.groupBy(*keys, "ordinal").agg(F.sum("done").alias("done"), F.max("needed").alias("needed"), last.alias("last"), F.max("before").alias("before"))
        here = merged.select(*keys, "ordinal", "done", "needed", "last.after", "last.place", "before").select(*keys, "ordinal", *waiting)
    columns = [*keys, "ordinal", "level", "position"]
    unplaced = lambda rows: rows.select(*keys, "ordinal", F.lit(None).cast("int").alias("level"), F.lit(None).cast("long").alias("position"))
    if not parts:
        return unplaced(known)
    placed = reduce(DataFrame.union, parts).select(columns)
    # No link meets a null id, so its rows are placed, but they would not meet themselves here.
    return placed.union(unplaced(known.dropna(subset=keys).join(placed.select(keys), keys, "left_anti")))


def unplaced(steps: DataFrame, edges: DataFrame) -> DataFrame:
    """The rows of topological(steps, edges) whose position is null.

    A workflow whose known links all go from a smaller ordinal to a larger one is placed whole, so only the others go through the rounds.
    """
    at = steps.groupBy("workflow_id", "step_id").agg(F.min("ordinal").alias("_low"), F.max("ordinal").alias("_high"), F.count_if(F.col("ordinal").isNull()).alias("_none"))
    end = lambda c: at.select("workflow_id", F.col("step_id").alias(c), *[F.col(k).alias(f"{k}_{c}") for k in ("_low", "_high", "_none")])
    known = edges.select("workflow_id", "src", "dst").join(end("src"), ["workflow_id", "src"]).join(end("dst"), ["workflow_id", "dst"])
    forward = (F.col("_high_src") < F.col("_low_dst")) & (F.col("_none_src") + F.col("_none_dst") == 0)
    rest = written(known.where(~F.coalesce(forward, F.lit(False))).select("workflow_id").distinct(), "backward")
    ordered = topological(steps.join(rest, "workflow_id", "left_semi"), edges.join(rest, "workflow_id", "left_semi"))
    return ordered.where("position IS NULL")


def cyclic_steps(ordered: DataFrame) -> DataFrame:
    """Steps that no round could place: in a cycle, or behind one."""
    return ordered.where("position IS NULL").select("workflow_id", "step_id")


def dry_run_plan(steps: DataFrame, ordered: DataFrame, skipped: DataFrame | None = None) -> DataFrame:
    """One row per pending step in order, with the command as written and as rendered."""
    keys = ["workflow_id", "step_id"]
    plan = steps.join(ordered.select(*keys, "level", "position"), keys)
    plan = plan if skipped is None else plan.join(skipped.select(keys), keys, "left_anti")
    rendered = render_command(F.col("command"), F.col("input"), F.col("output"))
    return plan.select(*keys, "position", "level", "tool", "command", rendered.alias("rendered"), "input", "output", "threads")


def first_fit(candidates: DataFrame, budget: int, most: int, part_rows: int = 100_000, rooms: DataFrame | None = None) -> DataFrame:
    """candidates(group_id, ordinal, step_id, weight) with taken and never_fits; weights are not negative.

    rooms(group_id, room) is what is left of the budget at first, in groups where that is less.

    Per group and in order: stop after ``most`` are taken; skip one that exceeds what is left of the budget and look on.
    A row that alone exceeds the budget never fits; one without a weight is not taken (its never_fits is null).

    A round takes, in every group, all rows up to the first that does not fit any more, by running sums inside ranges of about part_rows rows
    and over the ranges' totals, so that a large group goes through many tasks. Behind that row only lighter ones than it can fit, so there are no more
    rounds than different weights, and mostly very few.
    """
    rows = written(candidates.withColumn("_id", F.monotonically_increasing_id()), "candidates")
    parts = max(1, -(-rows.count() // part_rows))
    rows = written(rows.repartitionByRange(parts, "group_id", "ordinal", "weight", "_id").withColumn("_part", F.spark_partition_id()), "candidates")
    at = F.struct(F.col("ordinal").alias("o"), F.col("weight").cast("long").alias("w"), F.col("_id").alias("id")).alias("at")
    fitting = rows.where(F.col("weight") <= budget).select(F.col("group_id").alias("g"), "_part", at)
    state, taken = None, []
    while most > 0:
        if state is None:
            left = fitting.select("*", F.lit(budget).cast("long").alias("room"), F.lit(most).cast("long").alias("slots"))
            if rooms is not None:
                less = rooms.select(F.col("group_id").alias("_g"), F.col("room").cast("long").alias("_room"))
                left = left.join(less, F.col("g").eqNullSafe(F.col("_g")), "left").withColumn("room", F.coalesce("_room", "room")).drop("_g", "_room").where(F.col("at.w") <= F.col("room"))
        else:
            left = fitting.join(state, F.col("g").eqNullSafe(F.col("_g")) & (F.col("at") > F.col("_at")) & (F.col("at.w") <= F.col("room"))).drop("_g", "_at")
        so_far = Window.partitionBy("_part", "g").orderBy("at")
        inside = left.withColumns({"w": F.sum("at.w").over(so_far), "n": F.count("*").over(so_far)})
        earlier = Window.partitionBy("_h").orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
        totals = left.groupBy(F.col("g").alias("_h"), F.col("_part").alias("_p")).agg(F.sum("at.w").alias("_w"), F.count("*").alias("_n"))
        begun = totals.select("_h", "_p", F.coalesce(F.sum("_w").over(earlier), F.lit(0)).alias("_w"), F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_n"))
        met = inside.join(begun, F.col("g").eqNullSafe(F.col("_h")) & (F.col("_part") == F.col("_p")))
        fits = (F.col("w") + F.col("_w") <= F.col("room")) & (F.col("n") + F.col("_n") <= F.col("slots"))
        judged = written(met.select("g", "at", "room", "slots", fits.alias("fits")), "judged")
        taken.append(judged.where("fits").select(F.col("at.id").alias("_id")))
        sums = judged.groupBy(F.col("g").alias("_g")).agg(
            F.min(F.when(~F.col("fits"), F.col("at"))).alias("_at"),
            (F.first("room") - F.coalesce(F.sum(F.when(F.col("fits"), F.col("at.w"))), F.lit(0))).alias("room"),
            (F.first("slots") - F.count_if("fits")).alias("slots"),
        )
        state = written(sums.where("_at IS NOT NULL AND slots > 0"), "rooms")
        if state.isEmpty():
            break
    never = (F.col("weight") > budget).alias("never_fits")
    if not taken:
        return rows.select(*candidates.columns, F.lit(False).alias("taken"), never)
    found = reduce(DataFrame.union, taken).withColumn("_taken", F.lit(True))
    return rows.join(found, "_id", "left").select(*candidates.columns, F.coalesce("_taken", F.lit(False)).alias("taken"), never)
