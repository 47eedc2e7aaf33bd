import pytest
from pyspark.sql import functions as F

from pipelake.functions import exprs as X


def one(spark, column, **values):
    """The value of a column over one row of strings or lists."""
    types = ", ".join(f"{k} {'array<string>' if isinstance(v, list) else 'string'}" for k, v in values.items())
    return spark.createDataFrame([tuple(values.values())], types).select(column).first()[0]


@pytest.mark.parametrize("given, expected", [(["f1, f2 , f3"], ["f1", "f2", "f3"]), (["f1,,f2"], ["f1", "f2"]), (["f1", "f2,f3"], ["f1", "f2", "f3"]), ([], []), (["a", "a"], ["a", "a"])])
def test_file_list(spark, given, expected):
    assert one(spark, X.file_list(F.col("a")), a=given) == expected


def test_render_command_is_literal_and_in_order(spark):
    c = X.render_command(F.col("c"), F.col("i"), F.col("o"))
    assert one(spark, c, c="cat {input} > {output}", i=["a, b"], o=["c"]) == "cat a b > c"
    assert one(spark, c, c="{inputs}|{outputs}", i=["a"], o=["b"]) == "a|b"
    assert one(spark, c, c="{input}", i=["x{output}"], o=["y"]) == "xy"


@pytest.mark.parametrize("text, names", [("{id}_{replicate}.txt", ["id", "replicate"]), ("{a{b}", ["b"]), ("}{", []), ("{}", []), ("{a}{a}", ["a", "a"])])
def test_template_names(spark, text, names):
    assert one(spark, X.template_names(F.col("t")), t=text) == names


def test_is_template(spark):
    assert one(spark, X.is_template(F.col("t")), t="}{") is True
    assert one(spark, X.is_template(F.col("t")), t="{") is False
    assert one(spark, X.step_is_template(F.col("i"), F.col("o"), F.col("c")), i=["a"], o=["b"], c="run {input}") is True
    assert one(spark, X.expands(F.col("i"), F.col("o")), i=["{a", "b}"], o=["b"]) is True


def test_substitute(spark):
    assert one(spark, X.substitute(F.col("t"), F.lit("sample"), F.lit("sample1")), t="reads/{sample}.fastq") == "reads/sample1.fastq"


@pytest.mark.parametrize(
    "path, name, stem, extension, parent",
    [("d/a.tar.gz", "a.tar.gz", "a.tar", "gz", "d"), (".bashrc", ".bashrc", ".bashrc", None, ""), ("foo.", "foo.", "foo", "", ""), ("a/b/", "b", "b", None, "a"), ("x", "x", "x", None, "")],
)
def test_path_parts(spark, path, name, stem, extension, parent):
    assert [one(spark, X.path_part(F.col("p"), part), p=path) for part in ("name", "stem", "extension", "parent")] == [name, stem, extension, parent]


def test_editor_paths(spark):
    assert one(spark, X.path_part(F.col("p"), "stem", "editor"), p="a/.bashrc") == ""
    assert one(spark, X.path_part(F.col("p"), "stem", "editor"), p="a/b.tar.gz") == "b.tar"


def test_names(spark):
    assert one(spark, X.slug(F.col("t")), t="  Hello -- World! ") == "hello_world"
    assert one(spark, X.save_name(F.col("t")), t="My Run-1") == "my_run_1"
    assert one(spark, X.short_label(F.col("t")), t="short") == "short       "
    assert one(spark, X.short_label(F.col("t")), t="a_long_step_name") == "a_long_st..."


@pytest.mark.parametrize("line, severity", [("a failed error", "error"), ("all completed", "success"), ("is paused", "warning"), ("dry run", "info"), ("Error", ""), ("completed with error", "error")])
def test_log_severity(spark, line, severity):
    assert one(spark, X.log_severity(F.col("t")), t=line) == severity


def test_system_tools(spark):
    assert [one(spark, X.is_system_tool(F.col("t")), t=t) for t in ("bash", "bowtie2", "BASH", "tee")] == [True, False, False, True]
    assert one(spark, X.is_system_tool(F.col("t"), X.PLAN_SYSTEM_TOOLS), t="tee") is False
    assert (len(X.PLAN_SYSTEM_TOOLS), len(X.RUN_SYSTEM_TOOLS)) == (27, 42)


def test_suggest_output(spark):
    c = X.suggest_output(F.col("i"), F.col("o"))
    assert one(spark, c, i="reads/{sample}.fq", o="") == "output/{sample}.fq"
    assert one(spark, c, i="reads/{sample}.fq", o="kept") == "kept"
