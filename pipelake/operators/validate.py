"""Validation reports over many workflows at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pipelake.functions.exprs import stripped
from pipelake.operators.edges import duplicate_ids

COLUMNS = ("workflow_id", "step_id", "rule", "detail", "severity")


def _blank(c: str) -> Column:
    return stripped(F.coalesce(F.col(c), F.lit(""))) == ""


def field_violations(steps: DataFrame, mode: str = "full") -> DataFrame:
    """Violations that one row shows by itself.

    full: a blank id hides the step's other findings; an unused placeholder is a warning. quick: everything is reported, and unused
    placeholders are errors. editor: blank fields only.
    """
    severity = "warning" if mode == "full" else "error"
    checks = [("blank_id", _blank("step_id"), "error"), ("blank_tool", _blank("tool"), "error"), ("blank_command", _blank("command"), "error")]
    if mode != "editor":
        for mark, side in (("input", "input"), ("output", "output")):
            unused = F.contains("command", F.lit("{" + mark + "}")) & (F.size(F.coalesce(F.col(side), F.array().cast("array<string>"))) == 0)
            checks.append((f"{mark}_placeholder_without_{mark}", F.coalesce(unused, F.lit(False)), severity))
    hide = _blank("step_id") if mode == "full" else F.lit(False)
    found = [F.when(c if rule == "blank_id" else c & ~hide, F.struct(F.lit(rule).alias("rule"), F.lit(s).alias("severity"))) for rule, c, s in checks]
    opened = steps.select("workflow_id", "step_id", F.explode(F.array_compact(F.array(*found))).alias("v"))
    return opened.select("workflow_id", "step_id", "v.rule", F.lit(None).cast("string").alias("detail"), "v.severity")


def validation_report(workflows: DataFrame, steps: DataFrame, mode: str = "full", edges: DataFrame | None = None, ordered: DataFrame | None = None) -> DataFrame:
    """Violations of all workflows(workflow_id), in steps with previous and next lists.

    full: an empty workflow, or one with a duplicate id, gets that one finding alone (the first id that repeats, in the order of
    ordinal if steps have it); else field findings, unknown
    references both ways, and cycles (from ``ordered``, the result of graph.topological or of graph.unplaced). quick: no duplicates, no next
    references, no cycles. editor: empty, every repeated id, blank fields. ``edges(workflow_id, src, dst, declared_by)``
    replaces the steps' own lists.
    """
    text = lambda v: F.lit(v).cast("string")
    present = steps.select("workflow_id").distinct()
    empty = workflows.join(present, "workflow_id", "left_anti").select("workflow_id", text(None).alias("step_id"), F.lit("empty_workflow").alias("rule"), text(None).alias("detail"), F.lit("error").alias("severity"))
    parts = [empty]
    alone = None
    if mode == "full":
        order = [F.col("ordinal") if "ordinal" in steps.columns else F.lit(0), F.col("step_id")]
        seen = steps.select("workflow_id", "step_id", F.struct(*order).alias("_at"), F.row_number().over(Window.partitionBy("workflow_id", "step_id").orderBy(*order)).alias("_n"))
        alone = seen.where("_n = 2").groupBy("workflow_id").agg(F.min_by("step_id", "_at").alias("step_id"))
        parts.append(alone.select("workflow_id", "step_id", F.lit("duplicate_id").alias("rule"), text(None).alias("detail"), F.lit("error").alias("severity")))
    elif mode == "editor":
        again = duplicate_ids(steps).select("workflow_id", "step_id", F.explode(F.sequence(F.lit(2), F.col("n").cast("int"))).alias("detail"))
        parts.append(again.select("workflow_id", "step_id", F.lit("duplicate_id").alias("rule"), F.col("detail").cast("string").alias("detail"), F.lit("error").alias("severity")))
    # Findings are fewer than steps and edges, so these are not moved by workflow: their findings are.
    found = field_violations(steps, mode)
    if mode != "editor":
        if edges is None:
            edges = steps.select("workflow_id", F.explode("previous").alias("src"), F.col("step_id").alias("dst"), F.lit("previous").alias("declared_by")).union(
                steps.select("workflow_id", F.col("step_id").alias("src"), F.explode("next").alias("dst"), F.lit("next").alias("declared_by"))
            )
        known = steps.select("workflow_id", F.col("step_id").alias("detail"))
        for by, here, there in (("previous", "dst", "src"), ("next", "src", "dst")):
            if by == "next" and mode == "quick":
                continue
            refs = edges.where(F.col("declared_by") == by).select("workflow_id", F.col(here).alias("step_id"), F.col(there).alias("detail"))
            lost = refs.join(known, ["workflow_id", "detail"], "left_anti").join(present, "workflow_id", "left_semi")
            found = found.union(lost.select("workflow_id", "step_id", F.lit(f"unknown_{by}").alias("rule"), "detail", F.lit("error").alias("severity")))
    if mode == "full" and ordered is not None:
        cyclic = ordered.where("position IS NULL").select("workflow_id").distinct().join(present, "workflow_id", "left_semi")
        found = found.union(cyclic.select("workflow_id", text(None).alias("step_id"), F.lit("cycle").alias("rule"), text(None).alias("detail"), F.lit("error").alias("severity")))
    parts.append(found if alone is None else found.join(alone.select("workflow_id"), "workflow_id", "left_anti"))
    report = parts[0]
    for part in parts[1:]:
        report = report.union(part)
    return report.select(*COLUMNS)
