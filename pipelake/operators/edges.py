"""Dependencies between steps: derived from files, checked, looked up, edited."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pipelake.functions.exprs import RUN_SYSTEM_TOOLS, file_list, is_system_tool


def step_files(steps: DataFrame) -> DataFrame:
    """(workflow_id, step_id, ordinal, kind, pos, file) of steps with input and output lists."""
    keys = ["workflow_id", "step_id", "ordinal"]
    sides = [steps.select(*keys, F.lit(kind).alias("kind"), F.posexplode(file_list(F.col(column))).alias("pos", "file")) for kind, column in (("in", "input"), ("out", "output"))]
    return sides[0].union(sides[1])


def split_files(files: DataFrame) -> DataFrame:
    """step files with comma lists opened; pos stays that of the list."""
    return files.withColumn("file", F.explode(file_list(F.array("file"))))


def derive_edges(files: DataFrame) -> DataFrame:
    """Distinct (workflow_id, src, dst): a step that writes a file before one that reads it, by exact name.

    A step that reads its own output depends on itself. One equi-join; AQE picks its form and splits skew.
    """
    opened = split_files(files)
    outs = opened.where("kind = 'out'").select("workflow_id", "file", F.col("step_id").alias("src"))
    ins = opened.where("kind = 'in'").select("workflow_id", "file", F.col("step_id").alias("dst"))
    return outs.join(ins, ["workflow_id", "file"]).select("workflow_id", "src", "dst").distinct()


def declared_edges(steps: DataFrame) -> DataFrame:
    """(workflow_id, src, dst, declared_by) from the previous and next lists."""
    previous = steps.select("workflow_id", F.explode("previous").alias("src"), F.col("step_id").alias("dst"), F.lit("previous").alias("declared_by"))
    following = steps.select("workflow_id", F.col("step_id").alias("src"), F.explode("next").alias("dst"), F.lit("next").alias("declared_by"))
    return previous.union(following)


def populate_dependencies(steps: DataFrame) -> DataFrame:
    """steps with previous and next filled from files in workflows that declare none; sorted, without repeats."""
    declared = F.max(F.size("previous") + F.size("next")).over(Window.partitionBy("workflow_id")) > 0
    marked = steps.withColumn("_declared", declared)
    edges = derive_edges(step_files(marked.where("NOT _declared")))
    before = edges.groupBy("workflow_id", F.col("dst").alias("step_id")).agg(F.array_sort(F.collect_set("src")).alias("_previous"))
    after = edges.groupBy("workflow_id", F.col("src").alias("step_id")).agg(F.array_sort(F.collect_set("dst")).alias("_next"))
    joined = marked.join(before, ["workflow_id", "step_id"], "left").join(after, ["workflow_id", "step_id"], "left")
    return joined.withColumns({"previous": F.coalesce("_previous", "previous"), "next": F.coalesce("_next", "next")}).select(steps.columns)


def derived_counts(edges: DataFrame) -> DataFrame:
    """Per workflow: edges, and steps that depend on something."""
    return edges.groupBy("workflow_id").agg(F.count("*").alias("edges"), F.countDistinct("dst").alias("dependent_steps"))


def roots(steps: DataFrame, edges: DataFrame) -> DataFrame:
    """Steps that no edge enters."""
    return steps.join(edges.select("workflow_id", F.col("dst").alias("step_id")), ["workflow_id", "step_id"], "left_anti")


def leaves(steps: DataFrame, edges: DataFrame) -> DataFrame:
    """Steps that no edge leaves."""
    return steps.join(edges.select("workflow_id", F.col("src").alias("step_id")), ["workflow_id", "step_id"], "left_anti")


def dangling_refs(steps: DataFrame, edges: DataFrame) -> DataFrame:
    """(workflow_id, step_id, missing, direction): references of declared edges to steps that do not exist."""
    known = steps.select("workflow_id", F.col("step_id").alias("missing"))
    previous = edges.select("workflow_id", F.col("dst").alias("step_id"), F.col("src").alias("missing"), F.lit("previous").alias("direction"))
    following = edges.select("workflow_id", F.col("src").alias("step_id"), F.col("dst").alias("missing"), F.lit("next").alias("direction"))
    return previous.union(following).join(known, ["workflow_id", "missing"], "left_anti").select("workflow_id", "step_id", "missing", "direction")


def edge_asymmetry(next_edges: DataFrame, previous_edges: DataFrame) -> DataFrame:
    """Edges that only one side declares: (workflow_id, src, dst, lacks), as often as it declares them.

    Both sides are counted in one aggregation, so each is read and moved once. Null ends count as equal.
    """
    keys = ["workflow_id", "src", "dst"]
    of_side = lambda rows, side: rows.select(*keys, *[F.lit(int(side == s)).alias(s) for s in ("next", "previous")])
    counted = of_side(next_edges, "next").union(of_side(previous_edges, "previous")).groupBy(*keys).agg(F.sum("next").alias("_next"), F.sum("previous").alias("_previous"))
    alone = counted.where("_next = 0 OR _previous = 0").withColumn("lacks", F.when(F.col("_previous") == 0, "previous").otherwise("next"))
    return alone.select(*keys, F.explode(F.array_repeat("lacks", F.greatest("_next", "_previous").cast("int"))).alias("lacks"))


def tool_environments(steps: DataFrame, tool_env: DataFrame, system_tools: tuple[str, ...] = RUN_SYSTEM_TOOLS) -> DataFrame:
    """steps with env, and an error for a tool that is neither mapped nor a system tool."""
    found = steps.join(tool_env, "tool", "left")
    missing = F.col("env").isNull() & ~is_system_tool(F.col("tool"), system_tools)
    return found.withColumn("error", F.when(missing, F.concat(F.lit("no environment for tool "), "tool")))


def graph_adjacency(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(graph_id, node_id, step_id, previous, next): edge ends as step ids, in edge order.

    nodes(graph_id, node_id, step_id), edges(graph_id, pos, source, target); edges to unknown nodes are left out.
    """
    name = lambda c: nodes.select("graph_id", F.col("node_id").alias(c), F.col("step_id").alias(f"{c}_step"))
    ends = edges.join(name("source"), ["graph_id", "source"]).join(name("target"), ["graph_id", "target"])
    ordered = lambda c: F.transform(F.array_sort(F.collect_list(F.struct("pos", F.col(c).alias("id")))), lambda x: x["id"])
    before = ends.groupBy("graph_id", F.col("target").alias("node_id")).agg(ordered("source_step").alias("previous"))
    after = ends.groupBy("graph_id", F.col("source").alias("node_id")).agg(ordered("target_step").alias("next"))
    none = F.array().cast("array<string>")
    joined = nodes.join(before, ["graph_id", "node_id"], "left").join(after, ["graph_id", "node_id"], "left")
    return joined.withColumns({"previous": F.coalesce("previous", none), "next": F.coalesce("next", none)})


def graph_steps(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Steps of an editor graph: single input and output as lists, one thread each."""
    one = lambda c: F.when(F.coalesce(F.col(c), F.lit("")) == "", F.array().cast("array<string>")).otherwise(F.array(c))
    found = graph_adjacency(nodes, edges)
    return found.select(
        F.col("graph_id").alias("workflow_id"), F.col("pos").alias("ordinal"), "step_id", "tool", "command", one("input").alias("input"), one("output").alias("output"),
        "previous", "next", F.lit(1).alias("threads"), "color",
    )


def cascade_delete(edges: DataFrame, deletes: DataFrame) -> DataFrame:
    """edges(graph_id, source, target) without those that touch deletes(graph_id, node_id)."""
    left = edges.join(deletes.withColumnRenamed("node_id", "source"), ["graph_id", "source"], "left_anti")
    return left.join(deletes.withColumnRenamed("node_id", "target"), ["graph_id", "target"], "left_anti").select(edges.columns)


def delete_nodes(nodes: DataFrame, edges: DataFrame, files: DataFrame, deletes: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, edges, files) of editor graphs without deletes(graph_id, node_id): the nodes, the edges that touch them, and their sample files."""
    keys = ["graph_id", "node_id"]
    return nodes.join(deletes, keys, "left_anti"), cascade_delete(edges, deletes), files.join(deletes, keys, "left_anti")


def remove_steps(steps: DataFrame, deletes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(steps without the deleted ones and without references to them, deletes that name no step).

    References are opened to a row each, keep their places, and are joined with the deletes by key; only steps that lose one are put together anew.
    """
    keys = ["workflow_id", "step_id"]
    rest = steps.join(deletes, keys, "left_anti")
    own = [*keys, "previous", "next"]
    sides = [rest.select(*own, F.lit(side).alias("_side"), F.posexplode(side).alias("_at", "_ref")) for side in ("previous", "next")]
    gone = deletes.select("workflow_id", F.col("step_id").alias("_ref"), F.lit(True).alias("_gone")).distinct()
    met = sides[0].union(sides[1]).join(gone, ["workflow_id", "_ref"], "left")
    # collect_set: rows that repeat a step bring each of its references again.
    left = lambda side: F.transform(F.array_sort(F.collect_set(F.when((F.col("_side") == side) & F.col("_gone").isNull(), F.struct("_at", "_ref")))), lambda x: x["_ref"])
    changed = met.groupBy(*own).agg(F.bool_or(F.col("_gone").isNotNull()).alias("_lost"), left("previous").alias("_previous"), left("next").alias("_next")).where("_lost")
    changed = changed.select(*[F.col(c).alias(f"_k_{c}") for c in own], "_previous", "_next")
    joined = rest.join(changed, [F.col(c).eqNullSafe(F.col(f"_k_{c}")) for c in own], "left")
    cleaned = joined.withColumns({"previous": F.coalesce("_previous", "previous"), "next": F.coalesce("_next", "next")}).select(steps.columns)
    return cleaned, deletes.join(steps.select(keys), keys, "left_anti")


def declared_errors(steps: DataFrame) -> DataFrame:
    """(workflow_id, step_id, rule, detail): the first reference of each workflow to a step that it has not, as a load stops there.

    Steps go by ordinal; of a step, previous comes before next, each in its order.
    """
    refs = [steps.select("workflow_id", "ordinal", "step_id", F.lit(k).alias("_side"), F.posexplode(c).alias("_at", "_ref")) for k, c in enumerate(("previous", "next"))]
    known = steps.select("workflow_id", F.col("step_id").alias("_ref"))
    lost = refs[0].union(refs[1]).join(known, ["workflow_id", "_ref"], "left_anti")
    first = lost.groupBy("workflow_id").agg(F.min(F.struct("ordinal", "_side", "_at", "step_id", "_ref")).alias("e"))
    rule = F.when(F.col("e._side") == 0, "unknown_dependency").otherwise("unknown_dependent")
    return first.select("workflow_id", F.col("e.step_id").alias("step_id"), rule.alias("rule"), F.col("e._ref").alias("detail"))


def producer_errors(steps: DataFrame) -> DataFrame:
    """(workflow_id, step_id, rule, detail): in workflows that declare no dependency, the first file that a second step, or the same one again, produces.

    detail names the file and both producers; step_id is the second.
    """
    declares = steps.where((F.size("previous") > 0) | (F.size("next") > 0)).select("workflow_id").distinct()
    outs = step_files(steps.join(declares, "workflow_id", "left_anti")).where("kind = 'out'")
    by_file = Window.partitionBy("workflow_id", "file").orderBy("ordinal", "pos", "step_id")
    ranked = outs.select("workflow_id", "ordinal", "pos", "step_id", "file", F.row_number().over(by_file).alias("_n"), F.lag("step_id").over(by_file).alias("_first"))
    first = ranked.where("_n = 2").groupBy("workflow_id").agg(F.min(F.struct("ordinal", "pos", "step_id", "file", "_first")).alias("e"))
    detail = F.concat_ws(" ", F.col("e.file"), F.lit("from"), F.col("e._first"), F.lit("and"), F.col("e.step_id"))
    return first.select("workflow_id", F.col("e.step_id").alias("step_id"), F.lit("multiple_producers").alias("rule"), detail.alias("detail"))


def insert_absent(old: DataFrame, new: DataFrame, keys: list[str], order: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows of new that may be added, rows rejected because their key exists).

    Of new rows with one key the first is added, in the order of the ``order`` columns (by default of all columns), and the others are rejected.
    """
    window = Window.partitionBy(*keys).orderBy(*(order or new.columns))
    have = old.select(keys).distinct().withColumn("_have", F.lit(True))
    ranked = new.withColumn("_rank", F.row_number().over(window)).join(have, keys, "left")
    fits = F.col("_have").isNull() & (F.col("_rank") == 1)
    return ranked.where(fits).select(new.columns), ranked.where(~fits).select(new.columns)


def lookup_steps(steps: DataFrame, wanted: DataFrame) -> DataFrame:
    """Rows of steps whose key is in ``wanted(workflow_id, step_id)``."""
    return steps.join(wanted, ["workflow_id", "step_id"], "left_semi")


def apply_updates(rows: DataFrame, updates: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """rows with the last value per key and field of updates(keys, field, value, seq).

    One aggregation over the updates; an update to null counts, one to an unknown key does nothing.
    """
    last = updates.groupBy(*keys).pivot("field", fields).agg(F.max_by(F.struct("value"), "seq"))
    joined = rows.join(last.select(*keys, *[F.col(f).alias(f"_{f}") for f in fields]), keys, "left")
    return joined.withColumns({f: F.when(F.col(f"_{f}").isNotNull(), F.col(f"_{f}.value")).otherwise(F.col(f)) for f in fields}).select(rows.columns)


def append_dependency(previous: Column, step: Column) -> Column:
    return F.array_append(previous, step)


def distinct_tools(steps: DataFrame) -> DataFrame:
    return steps.groupBy("workflow_id").agg(F.array_sort(F.collect_set("tool")).alias("tools"))


def run_progress(steps: DataFrame, done: DataFrame) -> DataFrame:
    """Per workflow: total, completed, has_work. ``done(workflow_id, step_id)`` may name unknown steps."""
    marked = steps.select("workflow_id", "step_id").join(done.distinct().withColumn("_done", F.lit(1)), ["workflow_id", "step_id"], "left")
    return marked.groupBy("workflow_id").agg(F.count("*").alias("total"), F.count("_done").alias("completed")).withColumn("has_work", F.col("completed") < F.col("total"))


def duplicate_ids(steps: DataFrame) -> DataFrame:
    """(workflow_id, step_id, n) of ids that occur more than once."""
    return steps.groupBy("workflow_id", "step_id").agg(F.count("*").alias("n")).where("n > 1")


def multi_producers(outputs: DataFrame) -> DataFrame:
    """(workflow_id, file, first, second): files with two producers or more, in order of outputs(.., ordinal, pos)."""
    rank = F.row_number().over(Window.partitionBy("workflow_id", "file").orderBy("ordinal", "pos", "step_id"))
    ranked = outputs.select("workflow_id", "file", "step_id", rank.alias("rank")).where("rank <= 2")
    nth = lambda n: F.max(F.when(F.col("rank") == n, F.col("step_id")))
    found = ranked.groupBy("workflow_id", "file").agg(F.count("*").alias("n"), nth(1).alias("first"), nth(2).alias("second"))
    return found.where("n = 2").select("workflow_id", "file", "first", "second")


def missing_environments(steps: DataFrame, tool_env: DataFrame, system_tools: tuple[str, ...]) -> DataFrame:
    """Distinct tools that need an environment and have none."""
    return steps.select("tool").where(~is_system_tool(F.col("tool"), system_tools)).distinct().join(tool_env, "tool", "left_anti")
