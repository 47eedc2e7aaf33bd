"""Column expressions over file lists, templates, paths, names and log lines."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Tools that every system has, as known when environments are planned and when steps run.
PLAN_SYSTEM_TOOLS = (
    "bash", "sh", "echo", "cat", "cp", "mv", "rm", "mkdir", "sleep", "curl", "wget", "grep", "awk", "sed",
    "sort", "uniq", "head", "tail", "wc", "tr", "cut", "bc", "gzip", "gunzip", "tar", "zip", "unzip",
)
RUN_SYSTEM_TOOLS = (
    *PLAN_SYSTEM_TOOLS,
    "touch", "ls", "tee", "date", "find", "xargs", "diff", "comm", "paste", "rev", "fold", "printf", "test", "true", "false",
)
# The characters with the Unicode property White_Space.
WHITE_SPACE = "\t\n\x0b\x0c\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def stripped(text: Column) -> Column:
    """The text without white space at its ends; all of White_Space counts, not the blank alone."""
    return F.btrim(text, F.lit(WHITE_SPACE))


def file_list(files: Column) -> Column:
    """Every element split at commas, stripped, without empties; order and repeats stay. Null gives an empty list."""
    split = F.flatten(F.transform(F.coalesce(files, F.array().cast("array<string>")), lambda x: F.transform(F.split(x, ","), stripped)))
    return F.filter(split, lambda z: z != "")


def render_command(command: Column, inputs: Column, outputs: Column) -> Column:
    """The command with {input}, {output}, {inputs} and {outputs} filled in, in that order, as literal text."""
    into, out = F.array_join(file_list(inputs), " "), F.array_join(file_list(outputs), " ")
    for mark, value in (("{input}", into), ("{output}", out), ("{inputs}", into), ("{outputs}", out)):
        command = F.replace(command, F.lit(mark), value)
    return command


def is_template(text: Column) -> Column:
    """Both braces occur, in any order."""
    return F.contains(text, F.lit("{")) & F.contains(text, F.lit("}"))


def step_is_template(inputs: Column, outputs: Column, command: Column) -> Column:
    return F.exists(inputs, is_template) | F.exists(outputs, is_template) | is_template(command)


def expands(inputs: Column, outputs: Column) -> Column:
    """Whether a step takes part in expansion: its joined inputs, or an output, are templates."""
    return is_template(F.array_join(inputs, " ")) | F.exists(outputs, is_template)


def template_names(text: Column) -> Column:
    """Names between braces, in order, repeats kept."""
    return F.regexp_extract_all(text, F.lit(r"\{([^{}]+)\}"), F.lit(1))


def step_template_names(inputs: Column, outputs: Column) -> Column:
    return F.array_distinct(F.flatten(F.transform(F.concat(inputs, outputs), template_names)))


def substitute(text: Column, name: Column, value: Column) -> Column:
    return F.replace(text, F.concat(F.lit("{"), name, F.lit("}")), value)


def path_part(path: Column, part: str, style: str = "posix") -> Column:
    """``name``, ``stem``, ``extension`` or ``parent`` of a path.

    posix: trailing slashes do not count, a leading dot starts no extension, and a missing extension is null. editor: split at
    slashes only, and the stem loses everything from its last dot if something follows the dot.
    """
    if style == "editor":
        name = F.substring_index(path, "/", -1)
        parts = {"name": name, "stem": F.regexp_replace(name, r"\.[^.]+$", ""), "extension": F.nullif(F.regexp_extract(name, r"\.([^.]+)$", 1), F.lit(""))}
        return parts[part]
    bare = F.regexp_replace(path, "/+$", "")
    name = F.substring_index(bare, "/", -1)
    dotted = name.rlike(r"^(?s:.+)\.[^.]*$") & (name != "..")
    parts = {
        "name": name,
        "stem": F.when(dotted, F.regexp_extract(name, r"^((?s:.+))\.[^.]*$", 1)).otherwise(name),
        "extension": F.when(dotted, F.substring_index(name, ".", -1)),
        "parent": F.regexp_replace(F.regexp_extract(bare, r"^((?s:.*)/)[^/]*$", 1), "(?<=.)/+$", ""),
    }
    return parts[part]


def slug(label: Column) -> Column:
    """Lower case, runs of other characters as one underscore, none at the edges."""
    return F.regexp_replace(F.regexp_replace(stripped(F.lower(label)), "[^a-z0-9]+", "_"), "^_+|_+$", "")


def save_name(name: Column) -> Column:
    """File-safe name: each character but ASCII letters and digits becomes an underscore, then lower case."""
    return F.lower(F.regexp_replace(name, "[^A-Za-z0-9]", "_"))


def is_system_tool(tool: Column, tools: tuple[str, ...] = RUN_SYSTEM_TOOLS) -> Column:
    return tool.isin(*tools)


def log_severity(line: Column) -> Column:
    """error, success, warning, info or empty: the first that fits, case-sensitive."""
    has = lambda *words: F.greatest(*[F.contains(line, F.lit(w)) for w in words]) if len(words) > 1 else F.contains(line, F.lit(words[0]))
    return (
        F.when(has("error", "failed"), "error")
        .when(has("completed", "successfully"), "success")
        .when(has("paused"), "warning")
        .when(has("resumed", "dry run", "Wildcards"), "info")
        .otherwise("")
    )


def suggest_output(inputs: Column, output: Column) -> Column:
    """For a step without output and with an input pattern: the pattern under output/, else its own output.

    Only the first {sample} of the input counts.
    """
    at = F.instr(inputs, "{sample}")
    name = F.concat(F.lit("output/{sample}"), F.substr(inputs, at + 8, F.length(inputs)))
    return F.when((F.coalesce(output, F.lit("")) == "") & (at > 0), name).otherwise(output)


def short_label(label: Column) -> Column:
    """Twelve characters: padded, or the first nine and three dots."""
    return F.when(F.length(label) <= 12, F.rpad(label, 12, " ")).otherwise(F.concat(F.left(label, F.lit(9)), F.lit("...")))
