import json

import pytest

from pipelake.sources import files, specs

YAML = """
tools: [bash]
wildcardFiles: {sample: [a.fq]}
steps:
  - {id: one, tool: bash, command: "cat {input}", input: a.txt, output: ""}
  - {id: two, tool: bash, command: c, input: [b, "c,d"], previous: [one], threads: 3, color: red}
"""


def test_specs_are_coerced_and_broken_files_are_rows(spark, tmp_path):
    (tmp_path / "good.yaml").write_text(YAML)
    (tmp_path / "bad.yaml").write_text("this is not valid yaml: [[[")
    (tmp_path / "lacks.yaml").write_text("steps: [{id: x}]")
    found = specs.read_specs(spark, str(tmp_path))
    good = {r.step_id: r for r in found.where("parse_error IS NULL").collect()}
    assert (good["one"].input, good["one"].output, good["one"].threads, good["one"].previous) == (["a.txt"], [], 1, [])
    assert (good["two"].input, good["two"].threads, good["two"].color, good["two"].wildcard_files) == (["b", "c,d"], 3, "red", {"sample": ["a.fq"]})
    assert found.where("parse_error IS NOT NULL").count() == 2
    with pytest.raises(Exception, match="Scanner|Parser|lacks"):
        specs.read_specs(spark, str(tmp_path), "FAILFAST").collect()


def test_spec_round_trip(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "w.yaml").write_text(YAML)
    before = specs.read_specs(spark, str(tmp_path / "in"))
    specs.write_specs(before, str(tmp_path / "out"))
    after = specs.read_specs(spark, str(tmp_path / "out"))
    columns = ["ordinal", "step_id", "tool", "command", "input", "output", "previous", "next", "threads", "color", "wildcard_files"]
    assert sorted(map(str, before.select(columns).collect())) == sorted(map(str, after.select(columns).collect()))


def test_editor_graphs(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"nodes": [{"id": "n1", "data": {"label": "A"}}], "edges": [{"source": "n1", "target": "n1"}]}))
    (tmp_path / "b.json").write_text(json.dumps({"nodes": []}))
    graphs = specs.read_graphs(spark, str(tmp_path))
    assert sorted(r.valid for r in graphs.collect()) == [False, True]
    nodes, links = specs.graph_tables(graphs)
    assert [(r.node_id, r.label) for r in nodes.collect()] == [("n1", "A")]
    assert [(r.source, r.target) for r in links.collect()] == [("n1", "n1")]


def test_packages_and_environments(spark, tmp_path):
    (tmp_path / "list.txt").write_text("Name Version\n----\n bwa  0.7  x  y\n\nlone\nsamtools 1.9\n")
    assert sorted(r.package for r in files.read_packages(spark, str(tmp_path), 2).collect()) == ["bwa=0.7", "samtools=1.9"]
    names = spark.createDataFrame([("bwa",), ("none",)], "name string")
    assert {r.name: r.found for r in files.environment_exists(spark, str(tmp_path), names).collect()} == {"bwa": True, "none": False}


def test_tool_map(spark, tmp_path):
    assert files.read_tool_map(spark, str(tmp_path / "absent")).count() == 0
    changes = spark.createDataFrame([("a", "e1", 1), ("a", "e2", 2), ("b", "e3", 1)], "tool string, env string, seq int")
    files.write_tool_map(files.set_tools(files.read_tool_map(spark, str(tmp_path / "absent")), changes), str(tmp_path / "map"))
    assert sorted(tuple(r) for r in files.read_tool_map(spark, str(tmp_path / "map")).collect()) == [("a", "e2"), ("b", "e3")]


def test_manifest_and_logs(spark, tmp_path):
    (tmp_path / "run1.log").write_text("Step failed\nfine\n")
    assert [r.length for r in files.read_manifest(spark, str(tmp_path)).collect()] == [17]
    assert sorted((r.run_id, r.line) for r in files.read_log(spark, str(tmp_path)).collect()) == [("run1", "Step failed"), ("run1", "fine")]


def test_state_round_trip(spark, tmp_path):
    flows = spark.createDataFrame([("x/a.yaml",), ("y/a.yaml",)], "workflow_path string")
    assert files.read_state(spark, str(tmp_path / "s"), flows).where("size(completed) > 0").count() == 0
    snap = spark.createDataFrame([("x/a.yaml", ["1"], None)], "workflow_path string, completed array<string>, failed_step string").selectExpr("*", "timestamp'2024-01-01' AS updated_at")
    files.write_state(snap, str(tmp_path / "s"))
    assert {r.workflow_path: r.completed for r in files.read_state(spark, str(tmp_path / "s"), flows).collect()} == {"x/a.yaml": ["1"], "y/a.yaml": []}


def test_lines_are_numbered_as_they_stand(spark, tmp_path):
    (tmp_path / "run.log").write_text("zeta first\nalpha second\nmid third\n")
    found = files.numbered_lines(files.read_log(spark, str(tmp_path)))
    assert [(r.run_id, r.line) for r in found.orderBy("line_no").collect()] == [("run", "zeta first"), ("run", "alpha second"), ("run", "mid third")]


def test_workflows_with_one_save_name_stay_apart(spark, tmp_path):
    step = "ordinal int, step_id string, tool string, command string, input array<string>, output array<string>, previous array<string>, next array<string>, threads int, color string, wildcard_files map<string,array<string>>"
    before = spark.createDataFrame([(w, 0, "s", "t", "c", [], [], [], [], 1, None, None) for w in ("a/b", "a_b", "c")], "workflow_id string, " + step)
    specs.write_spec_files(before, str(tmp_path / "out"))
    found = specs.read_specs(spark, str(tmp_path / "out")).collect()
    assert len(found) == 3 and all(r.step_id == "s" for r in found)


def test_packed_documents_are_cut_into_ranges(spark, tmp_path):
    from pipelake.sources.documents import SPEC_ROWS, _Reader, spec_rows

    ids = ["plain", "ü/ö", 'quo"te', "", *[f"w{i}" for i in range(60)]]
    long = "x" * 900
    before = spark.createDataFrame([(w, i, f"s{i}", "t", long if w == "w7" else "c\n--- # no mark", ["a"], [], [], [], i, None, None) for w in ids for i in (1, 2)], SPEC_ROWS.split(",", 1)[1].rsplit(",", 1)[0])
    specs.write_specs(before.repartition(3), str(tmp_path / "out"))
    specs.write_specs(before.repartition(2), str(tmp_path / "out"))
    columns = [c for c in before.columns if c != "ordinal"]
    expected = sorted(map(str, before.select(columns).collect()))
    for split in (1, 97, 800, 5000, 1 << 20):
        reader = _Reader({"path": str(tmp_path / "out"), "splitbytes": str(split)}, spec_rows)
        parts = reader.partitions()
        got = [row for p in parts for row in reader.read(p)]
        assert len(got) == len(expected) and sorted((r[1], r[3]) for r in got) == sorted((w, f"s{i}") for w in ids for i in (1, 2))
        assert split > 100 or len(parts) > 5
    assert sorted(map(str, specs.read_specs(spark, str(tmp_path / "out")).select(columns).collect())) == expected


def test_packed_graphs_round_trip(spark, tmp_path):
    from pipelake.sources.documents import GRAPH_ROWS

    node = ("n1", ("A", "bash", "c {input}", "a.txt", None, None))
    rows = [("g1", [node], [("n1", "n1")], {"sample": ["a"]}, {"name": "x"}), ("g2", [], [], None, None), ("g3", None, [], None, None), ("g4", [node], None, None, None)]
    kind = GRAPH_ROWS.split("graph_id", 1)[1].rsplit(", valid", 1)[0]
    specs.write_graphs(spark.createDataFrame(rows, "graph_id" + kind), str(tmp_path / "out"))
    (tmp_path / "out" / "broken.json").write_text("{]")
    (tmp_path / "out" / "list.yaml").write_text("- a")
    found = {r.graph_id: r for r in specs.read_graphs(spark, str(tmp_path / "out")).collect()}
    assert {k: r.valid for k, r in found.items() if k.startswith("g")} == {"g1": True, "g2": True, "g3": False, "g4": False}
    assert (found["g1"].nodes[0].data.command, found["g1"].edges[0].target, found["g1"].wildcardFiles, found["g1"].metadata) == ("c {input}", "n1", {"sample": ["a"]}, {"name": "x"})
    assert sorted(bool(r.parse_error) for r in found.values()) == [False] * 4 + [True] * 2
    nodes, links = specs.graph_tables(specs.read_graphs(spark, str(tmp_path / "out")))
    assert (nodes.count(), links.count()) == (1, 1)


def test_a_failed_write_leaves_nothing(spark, tmp_path):
    from pyspark.sql import functions as F

    from pipelake.sources.documents import read_packed, write_packed

    rows = spark.range(0, 40, 1, 4).select(F.concat(F.lit("w"), "id").alias("id"), F.lit("steps: []").alias("document"))
    write_packed(rows, str(tmp_path / "out"))
    bad = rows.withColumn("document", F.when(F.col("id") == "w33", F.raise_error(F.lit("stop"))).otherwise(F.col("document")))
    with pytest.raises(Exception, match="stop"):
        write_packed(bad, str(tmp_path / "out"), mode="overwrite")
    # A task that outlives the job may stage a file yet; readers skip it.
    assert len(list((tmp_path / "out").glob("*.packed"))) == 4
    assert read_packed(spark, str(tmp_path / "out")).count() == 0


def test_documents_keep_the_order_of_long_ordinals(spark):
    columns = "workflow_id string, ordinal long, step_id string, tool string, command string, input array<string>, output array<string>, previous array<string>, next array<string>, threads int, color string, wildcard_files map<string,array<string>>"
    found = [("w", n << 32, f"s{n}", 't"', "c", [], [], [], [], 1, None, {"k": ["f"]} if n == 2 else None) for n in (3, 1, 2)]
    body = json.loads(specs.spec_documents(spark.createDataFrame(found, columns)).first().document)
    assert [s["id"] for s in body["steps"]] == ["s1", "s2", "s3"]
    assert body["tools"] == ['t"'] and body["steps"][1]["wildcard_files"] == {"k": ["f"]} and "color" not in body["steps"][0]
