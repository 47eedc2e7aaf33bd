"""Sample files, patterns and the expansion of templated steps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pipelake.functions.exprs import expands, path_part, step_is_template, step_template_names, substitute
from pipelake.operators.graph import written


def merge_files(files: DataFrame) -> DataFrame:
    """(workflow_id, name, files): each name's files, sorted, without repeats."""
    return files.groupBy("workflow_id", "name").agg(F.array_sort(F.collect_set("file")).alias("files"))


def merge_files_first_seen(files: DataFrame) -> DataFrame:
    """(workflow_id, files): all files under one name, in order of first appearance (pos)."""
    first = files.groupBy("workflow_id", "file").agg(F.min("pos").alias("pos"))
    return first.groupBy("workflow_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "file"))), lambda x: x["file"]).alias("files"))


def sample_values(files: DataFrame, style: str = "posix") -> DataFrame:
    """files with the sample value of each.

    posix: stems if the group's files have one extension between them (files without one do not count), else names.
    editor: always the stem.
    """
    if style == "editor":
        return files.withColumn("value", path_part(F.col("file"), "stem", "editor"))
    ext = files.select("*", path_part(F.col("file"), "extension").alias("_ext"))
    agreed = ext.groupBy("workflow_id", "name").agg((F.min("_ext") == F.max("_ext")).alias("_agreed"))
    value = F.when(F.coalesce("_agreed", F.lit(False)), path_part(F.col("file"), "stem")).otherwise(path_part(F.col("file"), "name"))
    return files.join(agreed, ["workflow_id", "name"]).withColumn("value", value).drop("_agreed")


def infer_patterns(files: DataFrame, style: str = "posix") -> DataFrame:
    """(workflow_id, name, pattern) from each group's first file: dir/{name}.ext.

    A file of the root directory gives //{name} in posix style and /{name} in editor style.
    """
    first = files.groupBy("workflow_id", "name").agg(F.min_by("file", "pos").alias("file"))
    tag = F.concat(F.lit("{"), F.col("name"), F.lit("}"))
    ext = path_part(F.col("file"), "extension", style)
    body = F.concat(tag, F.when(ext.isNotNull(), F.concat(F.lit("."), ext)).otherwise(""))
    if style == "editor":
        folder = F.regexp_extract("file", r"^((?s:.*)/)[^/]*$", 1)
        return first.select("workflow_id", "name", F.concat(folder, body).alias("pattern"))
    parent = path_part(F.col("file"), "parent")
    return first.select("workflow_id", "name", F.when(parent == "", body).otherwise(F.concat(parent, F.lit("/"), body)).alias("pattern"))


def preview(files: DataFrame, size: int = 5) -> DataFrame:
    """(workflow_id, name, names, more): base names of the first files, and how many follow."""
    window = Window.partitionBy("workflow_id", "name").orderBy("pos", "file")
    ranked = files.select("workflow_id", "name", "file", F.row_number().over(window).alias("rank"))
    return ranked.groupBy("workflow_id", "name").agg(
        F.transform(F.array_sort(F.collect_list(F.when(F.col("rank") <= size, F.struct("rank", path_part(F.col("file"), "name", "editor").alias("f"))))), lambda x: x["f"]).alias("names"),
        F.greatest(F.count("*") - size, F.lit(0)).alias("more"),
    )


def wildcard_violations(steps: DataFrame) -> DataFrame:
    """(workflow_id, step_id, name, rule): steps whose names cannot be filled from their own wildcard_files.

    Of a step with braces in input, output or command the first name without an entry is reported (``no_file_mapping``), or else, where
    it has more than one name, ``several_names`` with a null name.
    """
    names = step_template_names(F.col("input"), F.col("output"))
    asked = steps.where(step_is_template(F.col("input"), F.col("output"), F.col("command"))).select("workflow_id", "step_id", names.alias("names"), "wildcard_files")
    lacks = F.get(F.filter("names", lambda n: ~F.coalesce(F.map_contains_key("wildcard_files", n), F.lit(False))), F.lit(0))
    rule = F.when(lacks.isNotNull(), "no_file_mapping").when(F.size("names") > 1, "several_names")
    return asked.select("workflow_id", "step_id", lacks.alias("name"), rule.alias("rule")).where("rule IS NOT NULL")


def _fan_in(steps: DataFrame, instances: DataFrame) -> DataFrame:
    """(_row, _met): per step row its dependencies on steps that expand, in order, as (side, at, fan); side 0 is previous, 1 is next.

    instances(workflow_id, _ref, _fan) names the steps that expand. Each dependency is a row of its own, with its place, and meets its
    step by (workflow_id, step_id), so a join that adaptive execution can split carries the work. Only those that meet one are put together again.
    """
    of_side = lambda side, c: F.transform(c, lambda x, i: F.struct(F.lit(side).alias("side"), i.alias("at"), x.alias("ref")))
    refs = steps.select("_row", "workflow_id", F.explode(F.concat(of_side(0, "previous"), of_side(1, "next"))).alias("_d"))
    refs = refs.select("_row", "workflow_id", "_d.side", "_d.at", F.col("_d.ref").alias("_ref"))
    met = refs.join(instances, ["workflow_id", "_ref"])
    return met.groupBy("_row").agg(F.array_sort(F.collect_list(F.struct("side", "at", F.col("_fan").alias("fan")))).alias("_met"))


def _placed(refs: str, met: Column) -> Column:
    """The list refs as (at, ref, fan) in order; fan is null but where met has one for that place."""
    free = F.array_except(F.transform(refs, lambda x, i: i), F.transform(met, lambda m: m["at"]))
    none = F.lit(None).cast("array<string>")
    entry = lambda at, fan: F.struct(at.alias("at"), F.get(refs, at).alias("ref"), fan.alias("fan"))
    return F.array_sort(F.concat(F.transform(free, lambda i: entry(i, none)), F.transform(met, lambda m: entry(m["at"], m["fan"]))))


def expand_templates(steps: DataFrame, values: DataFrame, mode: str = "resolve", keep: tuple[str, ...] = ()) -> DataFrame:
    """Steps with templated ones repeated per sample value.

    steps(workflow_id, ordinal, step_id, command, input, output, previous, next); values(workflow_id, name, pos, value).
    Result: those columns with value_pos and error, and the columns to ``keep``. A step with several names, or a name that no group has, is an
    error row; a name with an empty list makes the step vanish. ``values`` rows with a null value stand for an empty list.

    mode ``reference`` adds the value to every dependency. mode ``resolve`` adds it only to templated ones; a plain step
    gets all instances of a templated dependency (of an id that repeats, those of all its steps in their order, each once).

    The steps are numbered and written once, so what comes back to a step meets it by one number; only steps with names are moved to meet their values.
    """
    none = F.array().cast("array<string>")
    names = F.when(expands(F.col("input"), F.col("output")), step_template_names(F.col("input"), F.col("output"))).otherwise(none)
    marked = steps.withColumns({"_names": names, "previous": F.coalesce("previous", none), "next": F.coalesce("next", none), "_row": F.monotonically_increasing_id()})
    marked = written(marked.withColumn("name", F.when(F.size("_names") == 1, F.col("_names")[0])), "marked")
    in_order = F.array_sort(F.collect_list(F.when(F.col("value").isNotNull(), F.struct("pos", "value"))))
    groups = values.groupBy("workflow_id", "name").agg(F.transform(in_order, lambda x: x["value"]).alias("_values"))
    templated = F.size("_names") > 0
    plain = marked.where(~templated).withColumn("_values", none)
    joined = marked.where(templated).join(groups, ["workflow_id", "name"], "left").unionByName(plain)
    error = F.when(F.size("_names") > 1, "more than one name").when(templated & F.col("_values").isNull(), "no file mapping")
    joined = joined.withColumn("error", error)
    value = F.col("_value")
    suffixed = lambda x: F.concat_ws("_", x, value)
    if mode == "reference":
        linked = joined
        links = {side: F.when(value.isNotNull(), F.transform(side, suffixed)).otherwise(F.col(side)) for side in ("previous", "next")}
    else:
        of_row = F.struct("ordinal", F.transform("_values", lambda v: F.concat_ws("_", F.col("step_id"), v)).alias("i"))
        of_id = joined.where(templated & F.col("error").isNull()).groupBy("workflow_id", "step_id").agg(F.array_sort(F.collect_list(of_row)).alias("_rows"))
        fan = F.array_distinct(F.flatten(F.transform("_rows", lambda r: r["i"])))
        met = _fan_in(marked, of_id.select("workflow_id", F.col("step_id").alias("_ref"), fan.alias("_fan")))
        linked = joined.join(met, "_row", "left")
        own = lambda d: F.array(F.when(d["fan"].isNotNull(), suffixed(d["ref"])).otherwise(d["ref"]))
        every = lambda d: F.coalesce(d["fan"], F.array(d["ref"]))
        of_side = {"previous": F.filter("_met", lambda m: m["side"] == 0), "next": F.filter("_met", lambda m: m["side"] == 1)}
        links = {
            side: F.when(F.size(F.coalesce(met_here, F.array().cast("array<struct<side:int,at:int,fan:array<string>>>"))) == 0, F.col(side))
            .when(value.isNotNull(), F.flatten(F.transform(_placed(side, met_here), own)))
            .otherwise(F.flatten(F.transform(_placed(side, met_here), every)))
            for side, met_here in of_side.items()
        }
    alone = F.array(F.lit(None).cast("string"))
    opened = linked.select("*", F.posexplode(F.when(templated & F.col("error").isNull(), F.col("_values")).otherwise(alone)).alias("value_pos", "_value"))
    filled = lambda text: substitute(text, F.col("name"), value)
    return opened.select(
        "workflow_id",
        "ordinal",
        "value_pos",
        F.when(value.isNotNull(), suffixed(F.col("step_id"))).otherwise(F.col("step_id")).alias("step_id"),
        *[F.when(value.isNotNull(), F.transform(c, filled)).otherwise(F.col(c)).alias(c) for c in ("input", "output")],
        F.when(value.isNotNull(), filled(F.col("command"))).otherwise(F.col("command")).alias("command"),
        links["previous"].alias("previous"),
        links["next"].alias("next"),
        *keep,
        "error",
    )
