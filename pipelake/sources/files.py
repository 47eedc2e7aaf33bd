"""Manifests, package listings, tool maps, events, samples, logs and state snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pipelake.functions.exprs import stripped
from pipelake.operators.state import latest_snapshots, state_key
from pipelake.operators.timeline import with_memory_mb
from pipelake.schemas import LIFECYCLE_EVENTS, RESOURCE_SAMPLES, STATE_SNAPSHOT

#: Runs of white space, of all Unicode kinds.
BLANKS = r"(?U)\s+"
#: Times in snapshots, to the microsecond.
MICROS = "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """(path, modified_at, length) of every file below path; contents are never read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("path", F.col("modificationTime").alias("modified_at"), "length")


def read_packages(spark: SparkSession, path: str, skip: int = 2) -> DataFrame:
    """(listing, package) from listings in blank-separated columns: the first ``skip`` lines of each file go, then lines with
    fewer than two fields; a package reads name=version. Search listings have two such lines, installed ones three."""
    text = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("listing"), "value")
    lines = text.select("listing", F.explode(F.slice(F.split("value", "\n"), skip + 1, 1_000_000_000)).alias("line"))
    fields = lines.select("listing", F.split(stripped(F.col("line")), BLANKS).alias("f")).where("size(f) >= 2")
    return fields.select("listing", F.concat_ws("=", F.col("f")[0], F.col("f")[1]).alias("package"))


def environment_exists(spark: SparkSession, path: str, names: DataFrame) -> DataFrame:
    """names(name) with found: some line of the environment listing starts with that field."""
    listed = spark.read.text(path).select(F.split(stripped(F.col("value")), BLANKS)[0].alias("name")).where("name <> ''").distinct().withColumn("found", F.lit(True))
    return names.join(listed, "name", "left").withColumn("found", F.coalesce("found", F.lit(False)))


def read_tool_map(spark: SparkSession, path: str) -> DataFrame:
    """(tool, env) of a JSON file with an object ``map``; a file that is missing or broken is an empty map."""
    try:
        found = spark.read.schema("map map<string,string>").option("multiLine", "true").json(path)
    except Exception as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        return spark.createDataFrame([], "tool string, env string")
    return found.select(F.explode("map").alias("tool", "env"))


def set_tools(tool_env: DataFrame, changes: DataFrame) -> DataFrame:
    """tool_env after changes(tool, env, seq); the last change of a tool wins."""
    both = tool_env.select("tool", "env", F.lit(-1).cast("long").alias("seq")).union(changes.select("tool", "env", F.col("seq").cast("long")))
    return both.groupBy("tool").agg(F.max_by("env", "seq").alias("env"))


def write_tool_map(tool_env: DataFrame, path: str) -> None:
    """The map as one JSON document. A map has one entry per tool, so it is small by nature."""
    tool_env.agg(F.map_from_entries(F.collect_list(F.struct("tool", "env"))).alias("map")).write.mode("overwrite").json(path)


def read_events(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(LIFECYCLE_EVENTS).parquet(path)


def stream_events(spark: SparkSession, path: str) -> DataFrame:
    return spark.readStream.schema(LIFECYCLE_EVENTS).parquet(path)


def read_samples(spark: SparkSession, path: str) -> DataFrame:
    return with_memory_mb(spark.read.schema(RESOURCE_SAMPLES).parquet(path))


def stream_samples(spark: SparkSession, path: str) -> DataFrame:
    return with_memory_mb(spark.readStream.schema(RESOURCE_SAMPLES).parquet(path))


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """(run_id, line, arrived_at, block, place): lines of log files, named after their file; arrival is the file's time.

    block and place order the lines of a file: where its split starts, and a number that grows along the split.
    """
    lines = spark.read.text(path)
    return _log(lines, F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("place"))


def stream_log(spark: SparkSession, path: str) -> DataFrame:
    return _log(spark.readStream.text(path))


def _log(lines: DataFrame, *places: Column) -> DataFrame:
    name = F.regexp_replace(F.col("_metadata.file_name"), r"\.[^.]*$", "")
    return lines.select(name.alias("run_id"), F.col("value").alias("line"), F.col("_metadata.file_modification_time").alias("arrived_at"), *places)


def read_state(spark: SparkSession, path: str, workflows: DataFrame) -> DataFrame:
    """The newest snapshot of each of workflows(workflow_path); a workflow without one starts fresh."""
    try:
        stored = latest_snapshots(spark.read.schema(STATE_SNAPSHOT).option("timestampFormat", MICROS).json(path))
    except Exception as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        stored = spark.createDataFrame([], STATE_SNAPSHOT)
    found = workflows.select("workflow_path").distinct().join(stored, "workflow_path", "left")
    return found.withColumn("completed", F.coalesce("completed", F.array().cast("array<string>")))


def write_state(snapshots: DataFrame, path: str) -> None:
    """Snapshots as JSON, keyed by their full path; state_key is kept beside it for look-ups by stem."""
    snapshots.withColumn("state_key", state_key(F.col("workflow_path"))).write.mode("overwrite").option("timestampFormat", MICROS).json(path)


def numbered_lines(log: DataFrame) -> DataFrame:
    """log with line_no within each run: in order of arrival and then of the lines in their file (of the text, where log has no places)."""
    order = ["arrived_at", *[c for c in ("block", "place") if c in log.columns], "line"]
    return log.withColumn("line_no", F.row_number().over(Window.partitionBy("run_id").orderBy(*order)).cast("long"))
