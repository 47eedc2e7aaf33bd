"""Run state: folded from events, resumed, and asked for the steps that can start."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pipelake.functions.exprs import path_part
from pipelake.operators.graph import first_fit


def state_fold(events: DataFrame) -> DataFrame:
    """(workflow_id, completed, failed_step, updated_at, is_resume) from Completed, Failed and Cleared events.

    After the last Cleared: every completed step, and the failed step if the last event is a failure.
    """
    order = F.struct("ts", "seq")
    cleared = events.groupBy("workflow_id").agg(F.max(F.when(F.col("event_type") == "Cleared", order)).alias("_cleared"))
    live = F.col("_cleared").isNull() | (order > F.col("_cleared"))
    marked = events.join(cleared, "workflow_id").withColumn("_live", live)
    done = F.col("_live") & (F.col("event_type") == "Completed")
    folded = marked.groupBy("workflow_id").agg(
        F.array_sort(F.collect_set(F.when(done, F.col("step_id")))).alias("completed"),
        F.max_by(F.struct(F.when(F.col("event_type") == "Failed", F.col("step_id")).alias("s")), order).alias("_last"),
        F.max("ts").alias("updated_at"),
    )
    folded = folded.select("workflow_id", "completed", F.col("_last.s").alias("failed_step"), "updated_at")
    return folded.withColumn("is_resume", (F.size("completed") > 0) | F.col("failed_step").isNotNull())


def resume_skips(completed: DataFrame, steps: DataFrame) -> DataFrame:
    """Completed (workflow_id, step_id) that the workflow still has: they are skipped on resume."""
    return completed.distinct().join(steps, ["workflow_id", "step_id"], "left_semi")


def ready_frontier(steps: DataFrame, edges: DataFrame, completed: DataFrame, running: DataFrame | None = None) -> DataFrame:
    """Steps that are neither completed nor running and whose predecessors are all completed; failed ones are not left out."""
    keys = ["workflow_id", "step_id"]
    busy = completed.select(keys) if running is None else completed.select(keys).union(running.select(keys))
    done = completed.select("workflow_id", F.col("step_id").alias("src")).distinct()
    blocked = edges.join(done, ["workflow_id", "src"], "left_anti").select("workflow_id", F.col("dst").alias("step_id"))
    return steps.join(busy, keys, "left_anti").join(blocked, keys, "left_anti")


def ready_steps(steps: DataFrame, edges: DataFrame, completed: DataFrame, running: DataFrame, max_threads: int, max_jobs: int) -> DataFrame:
    """steps(workflow_id, step_id, ordinal, threads) that may start now, with ``taken``.

    The ready frontier in the order of the steps: at most max_jobs of a workflow at a time, and one that needs more threads than those of
    max_threads that running(workflow_id, step_id) steps and earlier picks leave is passed over.
    """
    ready = ready_frontier(steps, edges, completed, running)
    used = running.distinct().join(steps.select("workflow_id", "step_id", "threads"), ["workflow_id", "step_id"]).groupBy("workflow_id").agg(F.sum("threads").alias("used"))
    rooms = used.select(F.col("workflow_id").alias("group_id"), (F.lit(max_threads) - F.col("used")).alias("room"))
    asked = ready.select(F.col("workflow_id").alias("group_id"), "ordinal", "step_id", F.col("threads").alias("weight"))
    picked = first_fit(asked, max_threads, max_jobs, rooms=rooms)
    return picked.select(F.col("group_id").alias("workflow_id"), "step_id", "ordinal", F.col("weight").alias("threads"), "taken")


def state_key(path: Column) -> Column:
    """Stem of the workflow's file, or ``workflow`` without one."""
    stem = path_part(path, "stem")
    return F.when(F.coalesce(stem, F.lit("")) == "", F.lit("workflow")).otherwise(stem)


def state_key_collisions(paths: DataFrame) -> DataFrame:
    """(state_key, paths) of keys that several workflow files share; paths(path)."""
    return paths.groupBy(state_key(F.col("path")).alias("state_key")).agg(F.countDistinct("path").alias("paths")).where("paths > 1")


def latest_snapshots(snapshots: DataFrame) -> DataFrame:
    """The newest snapshot of each workflow path; of equal times the one with more completed steps, and then the larger row."""
    newest = F.max_by(F.struct(*snapshots.columns), F.struct(F.col("updated_at").alias("_u"), F.size("completed").alias("_n"), *snapshots.columns))
    return snapshots.groupBy(F.col("workflow_path").alias("_path")).agg(newest.alias("s")).select("s.*")
