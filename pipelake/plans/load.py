"""The load path: from scanned specs to checked, expanded and ordered steps, for all workflows at once."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pipelake.functions import exprs
from pipelake.operators import edges, graph, templates, validate
from pipelake.operators.graph import written
from pipelake.plans import local

COLUMNS = ("workflow_id", "ordinal", "step_id", "tool", "command", "input", "output", "previous", "next", "threads", "color", "wildcard_files", "parse_error")
ERRORS = ("workflow_id", "stage", "step_id", "rule", "detail")


@dataclass
class Loaded:
    """steps: those of workflows that load, expanded, with level and position. errors(workflow_id, stage, step_id, rule, detail): why others do not; a
    workflow that fails in an early stage takes no part in later ones. warnings: findings that stop nothing."""

    steps: DataFrame
    errors: DataFrame
    warnings: DataFrame


def _errors(rows: DataFrame, stage: str) -> DataFrame:
    return rows.select("workflow_id", F.lit(stage).alias("stage"), "step_id", "rule", F.col("detail").cast("string").alias("detail"))


def load_workflows(specs: DataFrame, mode: str = "resolve", held: int = 100_000) -> Loaded:
    """Load scanned specs (the columns of specs.read_specs; parse_error and path are optional).

    Stages: parse errors; dependencies, declared ones checked (the first bad reference of a workflow) and the others derived from files (the first
    file with two producers); expansion over the merged sample files of each workflow's steps (``mode`` as in templates.expand_templates; the first
    step that cannot be expanded); validation in full; and the order. A list that is missing counts as empty.

    The specs are read and moved once. A workflow of up to ``held`` steps, references and files, which expands to no more, is loaded where its rows meet
    (plans.local). Larger ones, which no task should hold, go through the stages as joins over all of them.
    """
    none = F.array().cast("array<string>")
    lists = ("input", "output", "previous", "next")
    specs = specs.select(*[F.coalesce(c, none).alias(c) if c in lists else F.col(c) for c in COLUMNS if c in specs.columns])
    broken = F.col("parse_error").isNotNull() if "parse_error" in specs.columns else None
    of = Window.partitionBy("workflow_id", *([] if broken is None else [broken]))
    n_files = F.aggregate(F.map_values("wildcard_files"), F.lit(0).cast("long"), lambda n, x: n + 1 + F.size(F.coalesce(x, none)))
    weight = sum((F.size(c) for c in lists), F.lit(1).cast("long")) + F.when(F.col("wildcard_files").isNull(), 0).otherwise(n_files)
    fits = (F.sum(weight).over(of) <= held) & F.col("workflow_id").isNotNull()
    declares = F.max(F.size("previous") + F.size("next")).over(of) > 0
    names = F.when(exprs.expands(F.col("input"), F.col("output")), exprs.step_template_names(F.col("input"), F.col("output"))).otherwise(none)
    placed = specs.withColumns({"_names": names, "_n": F.count("*").over(of), "_local": fits if broken is None else fits & ~broken, "_declares": declares})
    marked = lambda mark, c: F.transform(F.coalesce(exprs.file_list(F.col(c)), none), lambda x: F.concat(F.lit(mark), x))
    entry = lambda e: F.concat(F.array(e["key"], F.coalesce(F.size(e["value"]), F.lit(-1)).cast("string")), F.coalesce(e["value"], none))
    blank = exprs.stripped(F.coalesce("tool", F.lit(""))) == ""
    bits = ((blank, local.BLANK_TOOL), (F.size("input") == 0, local.NO_INPUT), (F.size("output") == 0, local.NO_OUTPUT), (F.col("_declares"), local.DECLARES), (F.col("_local"), local.LOCAL))
    sent = placed.select(
        *[c for c in specs.columns if c != "wildcard_files"], "_n", sum((F.when(c, bit).otherwise(0) for c, bit in bits), F.lit(0)).alias("_flags"), "_names",
        F.when(~F.col("_declares"), F.concat(marked("i", "input"), marked("o", "output"))).alias("_own"),
        F.when(F.col("wildcard_files").isNotNull(), F.flatten(F.transform(F.map_entries("wildcard_files"), entry))).alias("_maps"),
    )
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in specs.schema.fields)
    done = written(sent.mapInArrow(local.loader(specs.columns, mode, held), f"{schema}, {local.ADDED}"), "load-local")

    value = F.col("value")
    filled = lambda text: exprs.substitute(text, F.col("name"), value)
    steps = done.where("kind = 'step'").select(
        "workflow_id", "step_id", _place("ordinal", "value_pos").alias("ordinal"),
        *[F.when(value.isNotNull(), F.transform(c, filled)).otherwise(F.col(c)).alias(c) for c in ("input", "output")],
        F.when(value.isNotNull(), filled(F.col("command"))).otherwise(F.col("command")).alias("command"),
        "previous", "next", "tool", "threads", "color", "level", "position",
    )
    errors = done.where("kind = 'error'").select(*ERRORS)
    warnings = done.where("kind = 'warning'").select("workflow_id", "step_id", "rule", "detail", F.lit("warning").alias("severity"))
    rest = done.where("kind = 'rest'").select(specs.columns)
    if broken is not None:
        errors = errors.union(_errors(rest.where(broken).select("workflow_id", F.lit(None).cast("string").alias("step_id"), F.lit("parse_error").alias("rule"), F.col("parse_error").alias("detail")), "parse"))
        rest = rest.where(~broken)
    if not rest.isEmpty():
        large = _load_joined(rest, mode)
        steps, errors, warnings = steps.unionByName(large.steps), errors.union(large.errors), warnings.union(large.warnings)
    return Loaded(steps, errors, warnings)


def _place(ordinal: str, value_pos: str) -> Column:
    """Steps keep the order of their step and, inside it, of the sample value."""
    return F.col(ordinal) * F.lit(1 << 32).cast("long") + F.coalesce(value_pos, F.lit(0))


def _load_joined(specs: DataFrame, mode: str) -> Loaded:
    """load_workflows without parse errors, by joins: each stage is one job over all workflows."""
    # Every stage reads the specs, so they are scanned once; else each plan would hold the scan and all that led to it several times.
    parsed = written(specs, "load-specs")
    without = lambda rows, bad: rows.join(bad.select("workflow_id").distinct(), "workflow_id", "left_anti")

    bad = written(_errors(edges.declared_errors(parsed), "dependencies").union(_errors(edges.producer_errors(parsed), "dependencies")), "load-dependencies")
    failed, parsed = bad, without(parsed, bad)
    linked = written(edges.populate_dependencies(parsed), "load-linked")

    named = linked.select("workflow_id", F.explode("wildcard_files").alias("name", "files")).select("workflow_id", "name", F.explode_outer("files").alias("file"))
    groups = named.groupBy("workflow_id", "name").agg(F.array_sort(F.collect_set("file")).alias("files"))
    files = groups.select("workflow_id", "name", F.posexplode("files").alias("pos", "file"))
    # A name with an empty list is known, and makes its steps vanish: a null value stands for it.
    values = templates.sample_values(files).select("workflow_id", "name", "pos", "value")
    values = values.union(groups.where(F.size("files") == 0).select("workflow_id", "name", F.lit(0).alias("pos"), F.lit(None).cast("string").alias("value")))
    opened = written(templates.expand_templates(linked, values, mode, keep=("tool", "threads", "color")), "load-expanded")
    stuck = opened.where("error IS NOT NULL").groupBy("workflow_id").agg(F.min_by(F.struct("step_id", "error"), F.struct("ordinal", "step_id")).alias("e"))
    bad = written(_errors(stuck.select("workflow_id", F.col("e.step_id").alias("step_id"), F.lit("not_expandable").alias("rule"), F.col("e.error").alias("detail")), "expansion"), "load-expansion")
    failed, opened = failed.union(bad), without(opened, bad)

    steps = written(opened.withColumn("ordinal", _place("ordinal", "value_pos")).drop("value_pos", "error"), "load-steps")
    links, needed = graph.declared_links(steps)
    ordered = written(graph.topological(steps, links, needed), "load-order")
    report = written(validate.validation_report(without(parsed, bad).select("workflow_id").distinct(), steps, "full", None, ordered), "load-report")
    wrong = report.where("severity = 'error'")
    failed = failed.union(_errors(wrong, "validation"))
    loaded = without(steps, wrong).join(ordered.select("workflow_id", "step_id", "level", "position"), ["workflow_id", "step_id"])
    return Loaded(loaded, failed, report.where("severity = 'warning'"))
