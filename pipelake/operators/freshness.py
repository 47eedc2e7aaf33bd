"""What is missing or out of date, from file manifests.

Files are opened to one row each and joined to the manifest by path. A path that ends in a slash exists if some file lies below
it, and has the newest time there; empty folders cannot be seen.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pipelake.functions.exprs import path_part


def with_manifest(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """files(.., file) with found and modified_at.

    A path is cut only at the depths that asked-for folders have, not at each of its own, and the newest time of a cut is taken before it moves.
    """
    names = manifest.groupBy(F.col("path").alias("file")).agg(F.max("modified_at").alias("modified_at"))
    wanted = files.where(F.col("file").endswith("/")).select("file").distinct()
    depths = sorted(r[0] for r in wanted.select(F.regexp_count("file", F.lit("/"))).distinct().collect())
    known = names
    if depths:
        parts = F.split("path", "/")
        above = F.transform(F.filter(F.array(*map(F.lit, depths)), lambda d: d < F.size(parts)), lambda d: F.concat(F.array_join(F.slice(parts, 1, d), "/"), F.lit("/")))
        cuts = manifest.select(F.explode(above).alias("file"), "modified_at").groupBy("file").agg(F.max("modified_at").alias("modified_at"))
        known = names.union(cuts.join(wanted, "file", "left_semi"))
    known = known.withColumn("found", F.lit(True))
    return files.join(known, "file", "left").withColumn("found", F.coalesce("found", F.lit(False)))


def rerun_steps(completed: DataFrame, outputs: DataFrame, manifest: DataFrame) -> DataFrame:
    """Rows of completed(workflow_id, step_id) whose outputs are not all there; a step without outputs counts as missing."""
    keys = ["workflow_id", "step_id"]
    there = with_manifest(outputs, manifest).groupBy(*keys).agg(F.bool_and("found").alias("_all"))
    return completed.join(there, keys, "left").where(~F.coalesce("_all", F.lit(False))).drop("_all")


def stale_outputs(steps: DataFrame, times: DataFrame) -> DataFrame:
    """(workflow_id, step_id, outdated) per step, from times(workflow_id, step_id, kind, modified_at, found).

    Outdated: an output is missing or there is none, or the newest existing input is newer than the oldest output, or either
    side has no time.
    """
    side = lambda kind: F.when((F.col("kind") == kind) & F.col("found"), F.col("modified_at"))
    keys = ["workflow_id", "step_id"]
    facts = times.groupBy(*keys).agg(
        F.max(side("in")).alias("_in"), F.min(side("out")).alias("_out"), F.coalesce(F.bool_and(F.when(F.col("kind") == "out", F.col("found"))), F.lit(False)).alias("_there")
    )
    joined = steps.select(*keys).distinct().join(facts, keys, "left")
    outdated = ~F.coalesce("_there", F.lit(False)) | F.coalesce(F.col("_in") > F.col("_out"), F.lit(True))
    return joined.select(*keys, outdated.alias("outdated"))


def should_run(stale: DataFrame, force: bool = False) -> DataFrame:
    return stale.withColumn("should_run", F.lit(force) | F.col("outdated"))


def missing_folders(outputs: DataFrame, manifest: DataFrame, working_dir: str = "") -> DataFrame:
    """(folder): distinct parents of the outputs, under the working folder, below which no file exists."""
    parent = path_part(F.col("file"), "parent")
    full = F.when(F.col("file").startswith("/") | (F.lit(working_dir) == ""), parent).otherwise(F.concat(F.lit(working_dir.rstrip("/") + "/"), parent))
    wanted = outputs.where(parent != "").select(full.alias("folder")).distinct()
    asked = wanted.select(F.concat("folder", F.lit("/")).alias("file"), "folder")
    return with_manifest(asked, manifest).where("NOT found").select("folder")
