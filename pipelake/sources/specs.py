"""Workflow definitions and editor graphs, read from and written to files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pipelake.functions.exprs import save_name
from pipelake.sources.documents import read_packed, write_packed

def read_specs(spark: SparkSession, path: str, mode: str = "PERMISSIVE") -> DataFrame:
    """One row per step of the YAML or JSON files below path; workflow_id is the file's path, or a packed document's id.

    A document that cannot be read is one row with parse_error (PERMISSIVE) or fails the job (FAILFAST).
    """
    return read_packed(spark, path, "workflow_specs", mode=mode)


def spec_documents(steps: DataFrame) -> DataFrame:
    """(workflow_id, document): one JSON document per workflow, its steps in order. JSON is YAML too, so read_specs reads it back.

    Empty color, wildcard_files and the tool list of a workflow without steps are left out.
    """
    step = F.struct(
        F.col("step_id").alias("id"), "tool", "command", "input", "output", "previous", "next", "threads", "color",
        F.when(F.size("wildcard_files") > 0, F.col("wildcard_files")).alias("wildcard_files"),
    )
    # Steps are sorted as (ordinal, text): a step holds a map, which has no order, and a comparison function is called for each pair.
    grouped = steps.groupBy("workflow_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("ordinal", F.to_json(step).alias("step")))), lambda x: x["step"]).alias("steps"),
        F.array_sort(F.collect_set("tool")).alias("tools"),
    )
    tools = F.when(F.size("tools") > 0, F.concat(F.lit(',"tools":'), F.to_json("tools")))
    document = F.concat(F.lit('{"steps":['), F.array_join("steps", ","), F.lit("]"), F.coalesce(tools, F.lit("")), F.lit("}"))
    return grouped.select("workflow_id", document.alias("document"))


def write_specs(steps: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Packed files of many workflows each; see sources.documents."""
    write_packed(spec_documents(steps).select(F.col("workflow_id").cast("string"), "document"), path, "workflow_specs", mode)


def write_spec_files(steps: DataFrame, path: str) -> None:
    """One file per workflow, in a folder named after its save name; where several share one, a hash of the id follows it."""
    identity = F.col("workflow_id").cast("string")
    documents = spec_documents(steps).withColumn("name", save_name(identity))
    shared = documents.groupBy("name").agg((F.count("*") > 1).alias("shared"))
    folder = F.when(F.col("shared"), F.concat("name", F.lit("-"), F.substring(F.sha2(identity, 256), 1, 16))).otherwise(F.col("name"))
    named = documents.join(shared, "name").select(folder.alias("workflow"), F.col("document").alias("value"))
    named.repartition("workflow").write.mode("overwrite").partitionBy("workflow").text(path)


def read_graphs(spark: SparkSession, path: str, mode: str = "PERMISSIVE") -> DataFrame:
    """One row per editor graph: path, graph_id, nodes, edges, wildcardFiles, metadata, valid, parse_error. A graph needs nodes and edges."""
    return read_packed(spark, path, "editor_graphs", mode=mode)


def graph_tables(graphs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(graph_nodes, graph_edges) of valid graphs, with positions."""
    valid = graphs.where("valid")
    nodes = valid.select("graph_id", F.posexplode("nodes").alias("pos", "n")).select("graph_id", F.col("n.id").alias("node_id"), "pos", "n.data.*")
    edges = valid.select("graph_id", F.posexplode("edges").alias("pos", "e")).select("graph_id", "pos", "e.*")
    return nodes, edges


def write_graphs(graphs: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Editor graphs (graph_id, nodes, edges, wildcardFiles, metadata) as packed files."""
    body = F.to_json(F.struct("nodes", "edges", "wildcardFiles", "metadata"))
    write_packed(graphs.select(F.col("graph_id").cast("string"), body.alias("document")), path, "editor_graphs", mode)
