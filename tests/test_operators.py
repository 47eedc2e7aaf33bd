import datetime as dt
import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pipelake.operators import edges, freshness, graph, state, templates, timeline, validate

STEP = "workflow_id string, ordinal int, step_id string, tool string, command string, input array<string>, output array<string>, previous array<string>, next array<string>"
T0 = dt.datetime(2024, 1, 1)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def steps_of(spark, *found):
    return spark.createDataFrame([("w", i, *f) for i, f in enumerate(found, 1)], STEP)


def test_derived_chain_fills_previous_and_next(spark):
    steps = steps_of(spark, ("1", "t", "c", [], ["a"], [], []), ("2", "t", "c", ["a"], ["b"], [], []), ("3", "t", "c", ["b"], ["c"], [], []))
    found = {r.step_id: (r.previous, r.next) for r in edges.populate_dependencies(steps).collect()}
    assert found == {"1": ([], ["2"]), "2": (["1"], ["3"]), "3": (["2"], [])}


def test_declared_edges_are_not_derived_again(spark):
    steps = steps_of(spark, ("1", "t", "c", [], ["a"], [], []), ("2", "t", "c", ["a"], [], [], ["1"]))
    assert {r.step_id: (r.previous, r.next) for r in edges.populate_dependencies(steps).collect()} == {"1": ([], []), "2": ([], ["1"])}


def test_own_output_is_a_self_edge(spark):
    steps = steps_of(spark, ("1", "t", "c", ["a"], ["a"], [], []))
    assert rows(edges.derive_edges(edges.step_files(steps))) == [("w", "1", "1")]


def test_remove_steps(spark):
    steps = steps_of(spark, ("1", "t", "c", [], [], [], ["2"]), ("2", "t", "c", [], [], ["1", "1"], []))
    left, unknown = edges.remove_steps(steps, spark.createDataFrame([("w", "1"), ("w", "9")], "workflow_id string, step_id string"))
    assert [(r.step_id, r.previous) for r in left.collect()] == [("2", [])]
    assert rows(unknown) == [("w", "9")]


def test_updates_keep_null_and_ignore_unknown(spark):
    base = spark.createDataFrame([("a", "x", "y"), ("b", "x", "y")], "id string, f string, g string")
    changes = spark.createDataFrame([("a", "f", "1", 1), ("a", "f", None, 2), ("b", "g", "z", 1), ("q", "g", "z", 1)], "id string, field string, value string, seq int")
    assert rows(edges.apply_updates(base, changes, ["id"], ["f", "g"])) == [("a", None, "y"), ("b", "x", "z")]


def test_graph_steps(spark):
    nodes = spark.createDataFrame([("g", "n1", 0, "a", "t", "c", "in", "", None), ("g", "n2", 1, "b", "t", "c", "", "out", None)], "graph_id string, node_id string, pos int, step_id string, tool string, command string, input string, output string, color string")
    links = spark.createDataFrame([("g", 0, "n1", "n2"), ("g", 1, "n1", "zz")], "graph_id string, pos int, source string, target string")
    found = {r.step_id: (r.input, r.output, r.previous, r.next) for r in edges.graph_steps(nodes, links).collect()}
    assert found == {"a": (["in"], [], [], ["b"]), "b": ([], ["out"], ["a"], [])}


def values_of(spark, *found):
    return spark.createDataFrame([("w", n, i, v) for i, (n, v) in enumerate(found)], "workflow_id string, name string, pos int, value string")


def test_expansion_modes_and_errors(spark):
    steps = steps_of(
        spark,
        ("a", "t", "run {sample}", ["{sample}.fq"], [], [], ["b"]),
        ("b", "t", "c", ["x"], [], ["a"], []),
        ("m", "t", "c", ["{x}{y}"], [], [], []),
        ("n", "t", "c", ["{none}"], [], [], []),
        ("e", "t", "c", ["{empty}"], [], [], []),
    ).drop("tool")
    values = values_of(spark, ("sample", "s1"), ("sample", "s2"), ("empty", None))
    found = {r.step_id: r for r in templates.expand_templates(steps, values).collect()}
    assert sorted(found) == ["a_s1", "a_s2", "b", "m", "n"]
    assert (found["a_s1"].command, found["a_s1"].input, found["a_s1"].next) == ("run s1", ["s1.fq"], ["b"])
    assert found["b"].previous == ["a_s1", "a_s2"]
    assert (found["m"].error, found["n"].error) == ("more than one name", "no file mapping")
    plain = {r.step_id: r for r in templates.expand_templates(steps, values, "reference").collect()}
    assert (plain["a_s1"].next, plain["b"].previous) == (["b_s1"], ["a"])


def test_sample_values_and_patterns(spark):
    files = spark.createDataFrame([("w", "s", i, f) for i, f in enumerate(["r/s1.fastq", "r/s2.fastq", "r/s3"])] + [("w", "t", 0, "/x.a"), ("w", "t", 1, "y.b")], "workflow_id string, name string, pos int, file string")
    assert [r.value for r in templates.sample_values(files).orderBy("name", "pos").collect()] == ["s1", "s2", "s3", "x.a", "y.b"]
    assert rows(templates.infer_patterns(files)) == [("w", "s", "r/{s}.fastq"), ("w", "t", "//{t}.a")]
    assert rows(templates.infer_patterns(files, "editor"))[1] == ("w", "t", "/{t}.a")


def events_of(spark, found):
    return spark.createDataFrame([("r", s, k, T0 + dt.timedelta(microseconds=u), i) for i, (s, k, u) in enumerate(found)], "run_id string, step_id string, event_type string, ts timestamp, seq long")


def fold_durations(found):
    start, out, origin = {}, {}, min((u for _, _, u in found), default=0)
    for s, k, u in sorted(found, key=lambda f: f[2]):
        if k == "Started":
            start[s] = (u - origin) // 1000
        elif s in start:
            out[s] = (u - origin) // 1000 - start[s]
    return out


EVENTS = st.lists(st.tuples(st.sampled_from("abc"), st.sampled_from(["Started", "Completed", "Failed"]), st.integers(0, 9000)), min_size=1, max_size=30, unique_by=lambda e: e[2])
SLOW = settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture, HealthCheck.too_slow])


@SLOW
@given(EVENTS)
def test_durations_equal_a_fold(spark, found):
    got = {r.step_id: r.duration_ms for r in timeline.step_durations(events_of(spark, found)).collect()}
    assert got == fold_durations(found)


@SLOW
@given(EVENTS)
def test_thread_profile_equals_a_fold(spark, found):
    events = events_of(spark, found).withColumn("threads", F.ascii("step_id") - 96)
    used, expected = 0, []
    for s, k, _ in sorted(found, key=lambda f: f[2]):
        used = max(0, used + (1 if k == "Started" else -1) * (ord(s) - 96))
        expected.append(used)
    assert [r.threads_in_use for r in timeline.thread_profile(events).orderBy("ts").collect()] == expected


def test_thread_profile_of_a_long_run_goes_in_parts(spark):
    rng = random.Random(4)
    found = [(rng.choice("abc"), rng.choice(["Started", "Completed", "Failed", "Skipped"]), i) for i in range(2000)]
    events = events_of(spark, found).withColumn("threads", F.ascii("step_id") - 96)
    sizes = [r["count"] for r in timeline.event_parts(events, part_rows=100).groupBy("_part").count().collect()]
    assert sum(sizes) == 2000 and max(sizes) < 400
    used, expected = 0, []
    for s, k, _ in found:
        used = max(0, used + {"Started": 1, "Skipped": 0}.get(k, -1) * (ord(s) - 96))
        expected.append(used)
    got = timeline.thread_profile(events, part_rows=100)
    assert [r.threads_in_use for r in got.orderBy("ts").collect()] == expected
    assert got.columns == [*events.columns, "threads_in_use"]


@SLOW
@given(st.lists(st.integers(0, 2_000_000), min_size=1, max_size=40, unique=True))
def test_thinning_equals_a_fold(spark, times):
    samples = spark.createDataFrame([("r", T0 + dt.timedelta(microseconds=u), i) for i, u in enumerate(times)], "run_id string, ts timestamp, seq long")
    ordered = sorted((u, i) for i, u in enumerate(times))
    last, expected = ordered[0][0], []
    for u, i in ordered[1:]:
        if u - last >= 250_000:
            last = u
            expected.append(i)
    assert sorted(r.seq for r in timeline.thin_samples(samples).collect()) == sorted(expected)
    assert sorted(r.seq for r in timeline.thin_long_runs(samples).collect()) == sorted(expected)


@SLOW
@given(st.lists(st.integers(1, 9), min_size=1, max_size=12), st.integers(1, 5))
def test_first_fit_equals_a_fold(spark, weights, most):
    rows_ = spark.createDataFrame([("g", i, f"s{i}", w) for i, w in enumerate(weights)], "group_id string, ordinal int, step_id string, weight int")
    left, expected = 8, []
    for i, w in enumerate(weights):
        if len(expected) < most and w <= left:
            expected.append(i)
            left -= w
    got = graph.first_fit(rows_, 8, most)
    assert sorted(r.ordinal for r in got.where("taken").collect()) == expected
    assert got.where("never_fits").count() == sum(w > 8 for w in weights)


def test_folds_hold_no_group_as_one_value(spark):
    """A group larger than a task's batch; the plan gathers no group in an array."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100")
    try:
        samples = spark.range(1000).select(F.lit("r").alias("run_id"), F.timestamp_micros(F.col("id") * 100_000).alias("ts"), F.col("id").alias("seq"))
        thinned = timeline.thin_samples(samples)
        assert sorted(r.seq for r in thinned.collect()) == list(range(3, 1000, 3))
        many = spark.range(1000).select(F.lit("g").alias("group_id"), F.col("id").cast("int").alias("ordinal"), F.lit("s").alias("step_id"), (F.col("id") % 2 * 4 + 1).alias("weight"))
        fitted = graph.first_fit(many, 505, 1000)
        assert fitted.columns == ["group_id", "ordinal", "step_id", "weight", "taken", "never_fits"]
        left, expected = 505, []
        for i in range(1000):
            if (w := i % 2 * 4 + 1) <= left:
                left -= w
                expected.append(i)
        assert sorted(r.ordinal for r in fitted.where("taken").collect()) == expected
        assert "collect_list" not in "".join(f._jdf.queryExecution().toString() for f in (thinned, fitted))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_thinning_of_one_long_run_goes_in_parts(spark):
    rng = random.Random(8)
    times, t = [], 0
    for _ in range(3000):
        t += rng.choice([0, 1, 9_000, 40_000, 260_000])
        times.append(t)
    samples = spark.createDataFrame([(None if i % 3 else "r", T0 + dt.timedelta(microseconds=u), i, "x") for i, u in enumerate(times)] + [("r", None, -1, "x")], "run_id string, ts timestamp, seq long, _last string").repartition(5)
    expected = []
    for run in (0, 1):
        last = None
        for i, u in enumerate(times):
            if bool(i % 3) == bool(run):
                if last is not None and u - last >= 250_000:
                    expected.append(i)
                last = u if last is None or u - last >= 250_000 else last
    for part_rows in (1, 40, 700):
        got = timeline.thin_samples(samples.drop("_last"), part_rows=part_rows)
        assert sorted(r.seq for r in got.collect()) == sorted(expected)


def test_first_fit_of_large_groups_goes_in_parts(spark):
    rng = random.Random(3)
    rows_ = [(rng.choice(["a", "b", None]), rng.randrange(400), f"s{i}", rng.choice([None, 0, 1, 2, 3, 7, 40, 90])) for i in range(1500)]
    frame = spark.createDataFrame(rows_, "group_id string, ordinal int, step_id string, weight int").coalesce(1)
    for budget, most in ((60, 1000), (500, 25), (5, 3), (60, 0)):
        expected = []
        for group in ("a", "b", None):
            left, n = budget, 0
            for _, w, i in sorted((r[1], r[3], i) for i, r in enumerate(rows_) if r[0] == group and r[3] is not None):
                if n < most and w <= left:
                    left, n = left - w, n + 1
                    expected.append(f"s{i}")
        got = graph.first_fit(frame, budget, most, part_rows=60)
        assert sorted(r.step_id for r in got.where("taken").collect()) == sorted(expected)
        assert got.count() == 1500


def in_batches(spark, folder, frame, count, seed=0):
    """A stream that reads the rows of frame in ``count`` batches, dealt at random, and a last one with what closes it."""
    rows_ = frame.collect()
    random.Random(seed).shuffle(rows_)
    size = -(-len(rows_) // count)
    for k in range(count):
        spark.createDataFrame(rows_[k * size : (k + 1) * size], frame.schema).coalesce(1).write.mode("append").parquet(folder)
    return spark.readStream.schema(frame.schema).option("maxFilesPerTrigger", 1).parquet(folder)


def closing(spark, folder, row, schema):
    import time

    time.sleep(1.1)  # a later file
    spark.createDataFrame([row], schema).coalesce(1).write.mode("append").parquet(folder)


@pytest.fixture
def rocks(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def test_live_durations_in_any_order_of_arrival(spark, tmp_path, rocks):
    from pyspark.sql import functions as F

    from pipelake.streaming import live

    rng = random.Random(1)
    found = [("r", f"s{rng.randrange(4)}", rng.choice(["Started", "Completed", "Failed"]), T0 + dt.timedelta(milliseconds=rng.randrange(500_000)), i) for i in range(120)]
    schema = "run_id string, step_id string, event_type string, ts timestamp, seq long"
    frame = spark.createDataFrame(found, schema)
    stream = in_batches(spark, str(tmp_path / "in"), frame, 4)
    closing(spark, str(tmp_path / "in"), ("end", "end", "Started", T0 + dt.timedelta(days=2), 1000), schema)
    first = frame.agg(F.min("ts").cast("string")).first()[0]
    got = live.run_to_table(live.live_durations(stream, origin=first, late="1 hour"), str(tmp_path / "state"))
    last = got.groupBy("run_id", "step_id").agg(F.max_by("duration_ms", F.struct("us", "seq")).alias("duration_ms"))
    assert rows(last) == rows(timeline.step_durations(frame))


def test_live_starts_expire(spark, tmp_path, rocks):
    from pipelake.streaming import live

    schema = "run_id string, step_id string, event_type string, ts timestamp, seq long"
    at = lambda s: T0 + dt.timedelta(seconds=s)
    frame = spark.createDataFrame([("r", "a", "Started", at(0), 1), ("r", "a", "Completed", at(5), 2), ("r", "b", "Started", at(0), 3), ("r", "b", "Completed", at(60), 4)], schema)
    stream = in_batches(spark, str(tmp_path / "in"), frame, 1)
    closing(spark, str(tmp_path / "in"), ("end", "end", "Started", at(86400), 9), schema)
    got = live.run_to_table(live.live_durations(stream, late="1 minute", expire_ms=20_000), str(tmp_path / "state"))
    assert [(r.step_id, r.duration_ms) for r in got.collect()] == [("a", 5000)]


def test_live_thinning_in_any_order_of_arrival(spark, tmp_path, rocks):
    from pipelake.streaming import live

    rng = random.Random(2)
    frame = spark.createDataFrame([(f"r{i % 2}", T0 + dt.timedelta(milliseconds=rng.randrange(20_000)), i, 1.0, 1 << 21) for i in range(200)], "run_id string, ts timestamp, seq long, cpu double, memory_bytes long")
    stream = in_batches(spark, str(tmp_path / "in"), frame, 3)
    closing(spark, str(tmp_path / "in"), ("end", T0 + dt.timedelta(days=1), 999, 1.0, 1), frame.schema)
    got = live.run_to_table(live.live_thinning(stream, 250), str(tmp_path / "state"))
    assert sorted(r.seq for r in got.collect()) == sorted(r.seq for r in timeline.thin_samples(frame).collect())


def test_live_state_grows_by_bucket_and_not_by_key(spark, tmp_path, rocks, monkeypatch):
    from pipelake.streaming import live

    monkeypatch.setattr(live, "BUCKETS", 8, raising=False)
    frame = spark.createDataFrame([(f"r{i % 100}", T0 + dt.timedelta(seconds=i), i, 1.0, 1 << 21) for i in range(300)], "run_id string, ts timestamp, seq long, cpu double, memory_bytes long")
    stream = in_batches(spark, str(tmp_path / "in"), frame, 1)
    closing(spark, str(tmp_path / "in"), ("end", T0 + dt.timedelta(days=1), 999, 1.0, 1), frame.schema)
    sink = live.live_thinning(stream, 250).writeStream.format("memory").queryName("by_bucket").option("checkpointLocation", str(tmp_path / "state"))
    run = sink.trigger(availableNow=True).start()
    run.awaitTermination()
    assert spark.table("by_bucket").count() == 200
    assert run.lastProgress["stateOperators"][0]["numRowsTotal"] < 60


def test_chunks_cut_anywhere_give_the_same_lines(spark, tmp_path, rocks):
    from pipelake.operators import logs
    from pipelake.streaming import live

    text = {("r", "out"): "één\r\ntwo\n\nthrée …\nrest".encode(), ("r", "err"): "日本語\nbad \n".encode(), ("q", "out"): b"no end"}
    schema = "run_id string, stream string, ts timestamp, seq long, data binary"
    for seed in range(2):
        rng = random.Random(seed)
        found, seq = [], 0
        for (run, name), data in text.items():
            cuts = sorted(rng.randrange(len(data) + 1) for _ in range(9))
            for a, b in zip([0, *cuts], [*cuts, len(data)]):
                seq += 1
                found.append((run, name, T0 + dt.timedelta(milliseconds=seq), seq, data[a:b]))
        found.append(("q", "err", T0, 0, None))
        frame = spark.createDataFrame(found, schema)
        got = logs.log_lines(frame, part_rows=5).collect()
        lines = lambda run, name: [r.line for r in sorted(got, key=lambda r: r.line_no) if (r.run_id, r.stream) == (run, name)]
        assert lines("r", "out") == ["één", "two", "", "thrée …", "rest"] and lines("r", "err") == ["日本語", "bad "] and lines("q", "out") == ["no end"]
        assert sorted(r.line_no for r in got if r.run_id == "r") == list(range(1, 8))
        stream = in_batches(spark, str(tmp_path / f"in{seed}"), frame, 3, seed)
        closing(spark, str(tmp_path / f"in{seed}"), ("end", "out", T0 + dt.timedelta(days=1), 999, b"x"), schema)
        live_got = live.run_to_table(live.live_log_lines(stream), str(tmp_path / f"state{seed}"))
        whole = lambda rs: sorted((r.run_id, r.line_no, r.stream, r.line) for r in rs)
        assert whole(live_got.collect()) == whole(r for r in got if r.complete)


def test_upserts_touch_their_buckets_and_survive_replays(spark, tmp_path):
    import os

    from pipelake.streaming.tables import UpsertTable, newest

    schema = "k string, v long"
    table = lambda: UpsertTable(spark, str(tmp_path / "t"), ["k"], newest(["k"], ["v"]), buckets=8)
    batch = lambda *found: spark.createDataFrame(list(found), schema)
    assert rows(table().read(schema)) == []
    table().upsert(batch(*[(f"k{i}", i) for i in range(40)]), 0)
    table().upsert(batch(("k1", 100), ("k1", 99), ("new", 5)), 1)
    now = rows(table().read(schema))
    assert now == sorted([("k1", 100), ("new", 5), *[(f"k{i}", i) for i in range(40) if i != 1]], key=str)
    assert len(os.listdir(tmp_path / "t" / "rows" / "batch=1")) <= 4
    # A replay, and one that was killed before its commit.
    table().upsert(batch(("k1", 100), ("k1", 99), ("new", 5)), 1)
    assert rows(table().read(schema)) == now
    with pytest.raises(Exception, match="stop"):
        table().upsert(batch(("k2", 7)).withColumn("v", F.when(F.col("k") == "k2", F.raise_error(F.lit("stop")).cast("long"))), 2)
    assert rows(table().read(schema)) == now
    table().upsert(batch(("k2", 7)), 2)
    assert ("k2", 7) in rows(table().read(schema)) and table().vacuum(keep=1) > 0
    assert len(rows(table().read(schema))) == 41


def test_snapshots_merge_in_any_order(spark):
    from pipelake.streaming import live

    rng = random.Random(7)
    schema = "workflow_id string, step_id string, event_type string, ts timestamp, seq long"
    found = [(f"w{rng.randrange(3)}", f"s{rng.randrange(5)}", rng.choice(["Completed"] * 5 + ["Failed", "Cleared"]), T0 + dt.timedelta(seconds=rng.randrange(50)), i) for i in range(90)]
    expected = rows(state.state_fold(spark.createDataFrame(found, schema)))
    for seed in range(3):
        random.Random(seed).shuffle(found)
        parts = spark.createDataFrame([], live.SNAPSHOT.format("string"))
        for a in (0, 20, 50, 50):  # the last batch comes twice
            events = spark.createDataFrame(found[a : {0: 20, 20: 50, 50: 90}[a]], schema)
            parts = live.merge_parts(parts, live.snapshot_parts(events))
        assert rows(live.folded_parts(parts)) == expected


def queue_order(n, links):
    """First-in first-out order on step numbers; edges leave in child order."""
    into = {d: sum(1 for _, x in links if x == d) for d in range(n)}
    queue, out = [i for i in range(n) if not into[i]], []
    while queue:
        s = queue.pop(0)
        out.append(s)
        for d in sorted(x for y, x in links if y == s):
            into[d] -= 1
            if not into[d]:
                queue.append(d)
    return out


def test_topological_order_equals_a_queue(spark):
    rng = random.Random(3)
    graphs = {f"w{g}": (n := rng.randint(1, 7), {(rng.randrange(n), rng.randrange(n)) for _ in range(rng.randint(0, 8))}) for g in range(40)}
    steps = spark.createDataFrame([(w, f"s{i}", i) for w, (n, _) in graphs.items() for i in range(n)], "workflow_id string, step_id string, ordinal int")
    links = spark.createDataFrame([(w, f"s{a}", f"s{b}") for w, (_, e) in graphs.items() for a, b in e], "workflow_id string, src string, dst string")
    found = graph.topological(steps, links).collect()
    for w, (n, e) in graphs.items():
        placed = sorted((r.position, r.ordinal) for r in found if r.workflow_id == w and r.position)
        assert [o for _, o in placed] == queue_order(n, e)
        assert sum(1 for r in found if r.workflow_id == w) == n


def test_declared_order_and_modes(spark):
    steps = steps_of(spark, ("a", "t", "c", [], [], [], ["z", "b"]), ("b", "t", "c", [], [], ["a"], []), ("c", "t", "c", [], [], ["a"], []), ("z", "t", "c", [], [], ["a"], []))

    def order(mode):
        return [r.step_id for r in graph.topological(steps, *graph.declared_links(steps, mode)).where("position IS NOT NULL").orderBy("position").collect()]

    assert order("union") == ["a", "z", "b", "c"]
    assert order("reference") == ["a", "z", "b"]


def test_a_chain_longer_than_the_rounds_is_no_cycle(spark):
    steps = spark.createDataFrame([("w", f"s{i}", i) for i in range(4)], "workflow_id string, step_id string, ordinal int")
    links = spark.createDataFrame([("w", f"s{i}", f"s{i + 1}") for i in range(3)], "workflow_id string, src string, dst string")
    with pytest.raises(RuntimeError):
        graph.topological(steps, links, max_rounds=3)
    assert graph.cyclic_steps(graph.topological(steps, links, max_rounds=4)).count() == 0


def test_topological_of_nothing(spark):
    steps = spark.createDataFrame([], "workflow_id string, step_id string, ordinal int")
    assert graph.topological(steps, spark.createDataFrame([], "workflow_id string, src string, dst string")).count() == 0


def test_state_fold(spark):
    def state_of(*found):
        events = spark.createDataFrame([("w", s, k, T0, i) for i, (s, k) in enumerate(found)], "workflow_id string, step_id string, event_type string, ts timestamp, seq long")
        r = state.state_fold(events).first()
        return r.completed, r.failed_step, r.is_resume

    assert state_of(("a", "Failed"), ("a", "Completed")) == (["a"], None, True)
    assert state_of(("a", "Completed"), ("b", "Failed")) == (["a"], "b", True)
    assert state_of(("a", "Completed"), ("", "Cleared")) == ([], None, False)


def test_frontier(spark):
    steps = spark.createDataFrame([("w", "s1"), ("w", "s2")], "workflow_id string, step_id string")
    links = spark.createDataFrame([("w", "s1", "s2")], "workflow_id string, src string, dst string")
    none = steps.where("false")
    assert rows(state.ready_frontier(steps, links, none)) == [("w", "s1")]
    assert rows(state.ready_frontier(steps, links, steps.where("step_id = 's1'"))) == [("w", "s2")]
    assert rows(state.ready_frontier(steps, links, none, steps.where("step_id = 's1'"))) == []


def test_freshness(spark):
    old, new = T0, T0 + dt.timedelta(hours=1)
    times = spark.createDataFrame(
        [("fresh", "in", old, True), ("fresh", "out", new, True), ("stale", "in", new, True), ("stale", "out", old, True), ("noin", "out", old, True), ("gone", "in", old, True), ("gone", "out", None, False), ("same", "in", old, True), ("same", "out", old, True)],
        "step_id string, kind string, modified_at timestamp, found boolean",
    )
    steps = times.select("step_id").union(spark.createDataFrame([("none",)], "step_id string"))
    times, steps = (x.withColumn("workflow_id", F.lit(1)) for x in (times, steps))
    other = times.where("step_id = 'stale'").withColumns({"workflow_id": F.lit(2), "modified_at": F.lit(None).cast("timestamp")})
    both = freshness.stale_outputs(steps.select("workflow_id", "step_id").union(other.select("workflow_id", "step_id")), times.unionByName(other))
    assert rows(both.where("workflow_id = 2").select("step_id", "outdated")) == [("stale", True)]
    assert rows(both.where("workflow_id = 1").select("step_id", "outdated")) == [("fresh", False), ("gone", True), ("noin", True), ("none", True), ("same", False), ("stale", True)]


def test_folders_count_as_files(spark):
    manifest = spark.createDataFrame([("qc/a.html", T0), ("qc/b/c", T0 + dt.timedelta(hours=1))], "path string, modified_at timestamp")
    files = spark.createDataFrame([("qc/",), ("no/",), ("qc/a.html",)], "file string")
    assert {r.file: (r.found, r.modified_at) for r in freshness.with_manifest(files, manifest).collect()} == {"qc/": (True, T0 + dt.timedelta(hours=1)), "no/": (False, None), "qc/a.html": (True, T0)}


def test_validation_modes(spark):
    steps = spark.createDataFrame(
        [("ok", "a", "t", "c", [], [], [], []), ("dup", "x", "t", "c", [], [], [], []), ("dup", "x", "", "c", [], [], [], []), ("bad", " ", "", "", [], [], [], []), ("ref", "r", "t", "{input}", [], [], ["zz"], ["yy"])],
        "workflow_id string, step_id string, tool string, command string, input array<string>, output array<string>, previous array<string>, next array<string>",
    )
    flows = spark.createDataFrame([("ok",), ("dup",), ("bad",), ("ref",), ("none",)], "workflow_id string")
    report = lambda mode: sorted((r.workflow_id, r.rule, r.severity) for r in validate.validation_report(flows, steps, mode).collect())
    e = "error"
    assert report("full") == [("bad", "blank_id", e), ("dup", "duplicate_id", e), ("none", "empty_workflow", e), ("ref", "input_placeholder_without_input", "warning"), ("ref", "unknown_next", e), ("ref", "unknown_previous", e)]
    assert report("quick") == [("bad", "blank_command", e), ("bad", "blank_id", e), ("bad", "blank_tool", e), ("dup", "blank_tool", e), ("none", "empty_workflow", e), ("ref", "input_placeholder_without_input", e), ("ref", "unknown_previous", e)]
    assert report("editor") == [("bad", "blank_command", e), ("bad", "blank_id", e), ("bad", "blank_tool", e), ("dup", "blank_tool", e), ("dup", "duplicate_id", e), ("none", "empty_workflow", e)]


def test_resource_summary_without_samples(spark):
    samples = spark.createDataFrame([], "run_id string, ts timestamp, seq long, cpu double, memory_bytes long")
    r = timeline.resource_summary(samples, spark.createDataFrame([("r",)], "run_id string")).first()
    assert (r.samples, r.avg_cpu, r.peak_mb, r.text) == (0, 0.0, 0, "No resource data collected")


def test_a_new_id_is_added_once(spark):
    old = spark.createDataFrame([(1, "a")], "workflow_id int, step_id string")
    new = spark.createDataFrame([(1, "b", 2), (1, "b", 1), (1, "a", 3), (2, "a", 4)], "workflow_id int, step_id string, line int")
    added, rejected = edges.insert_absent(old, new, ["workflow_id", "step_id"], ["line"])
    assert sorted(tuple(r) for r in added.collect()) == [(1, "b", 1), (2, "a", 4)]
    assert sorted(tuple(r) for r in rejected.collect()) == [(1, "a", 3), (1, "b", 2)]


def test_the_first_repeated_id_is_reported(spark):
    rows_of = [(1, i, s, "t", "c", [], [], [], []) for i, s in enumerate("zzaa")]
    steps = spark.createDataFrame(rows_of, "workflow_id int, ordinal int, step_id string, tool string, command string, input array<string>, output array<string>, previous array<string>, next array<string>")
    found = validate.validation_report(steps.select("workflow_id").distinct(), steps, "full").collect()
    assert [(r.step_id, r.rule) for r in found] == [("z", "duplicate_id")]


def test_a_templated_id_may_repeat(spark):
    kind = "workflow_id int, ordinal int, step_id string, command string, input array<string>, output array<string>, previous array<string>, next array<string>"
    steps = spark.createDataFrame([(1, 0, "t", "c", ["{x}"], ["{x}.o"], [], []), (1, 1, "t", "c", ["{y}"], ["{y}.o"], [], []), (1, 2, "p", "c", [], [], ["t"], [])], kind)
    values = spark.createDataFrame([(1, "x", 0, "a"), (1, "y", 0, "a"), (1, "y", 1, "b")], "workflow_id int, name string, pos int, value string")
    found = {(r.ordinal, r.step_id): r.previous for r in templates.expand_templates(steps, values).collect()}
    assert found == {(0, "t_a"): [], (1, "t_a"): [], (1, "t_b"): [], (2, "p"): ["t_a", "t_b"]}


def test_remove_steps_keeps_places_and_repeated_rows(spark):
    one = ("1", "t", "c", [], [], ["9", "x", "9", "y"], [])
    frame = steps_of(spark, one, ("x", "t", "c", [], [], [], ["1", "y"])).union(spark.createDataFrame([("w", 1, *one)], STEP))
    left, unknown = edges.remove_steps(frame, spark.createDataFrame([("w", "x"), ("w", "x")], "workflow_id string, step_id string"))
    assert [(r.step_id, r.previous) for r in left.collect()] == [("1", ["9", "9", "y"])] * 2
    assert rows(unknown) == []


def test_a_load_stops_at_the_first_error_of_a_workflow(spark):
    from pipelake.plans import load

    columns = STEP + ", threads int, color string, wildcard_files map<string,array<string>>, parse_error string"
    step = lambda w, i, s, inputs, outputs, previous=(), following=(), files=None, error=None: (w, i, s, "bash", "run", list(inputs), list(outputs), list(previous), list(following), 1, None, files, error)
    found = [
        step("bad", None, None, (), (), error="no steps"),
        step("refs", 1, "a", ["x"], [], following=["nope"]), step("refs", 2, "b", [], [], previous=["gone", "a"]),
        step("two", 1, "a", [], ["f\t, g"]), step("two", 2, "b", [], [" g"]),
        step("map", 1, "a", ["{s}"], []), step("map", 2, "b", ["{s}{t}"], []),
        step("loop", 1, "a", ["y"], ["x"]), step("loop", 2, "b", ["x"], ["y"]),
        step("fine", 1, "align", ["in/{s}.fq"], ["{s}.bam"], files={"s": ["b.fq", "a.fq"]}), step("fine", 2, "sum", ["{s}.bam,\n all"], ["out"]), step("fine", 3, "end", ["out"], []),
        step("none", 1, "gone", ["{s}"], ["f"], files={"s": []}), step("none", 2, "stays", ["x"], []),
    ]
    got = load.load_workflows(spark.createDataFrame(found, columns))
    assert rows(got.errors.select("workflow_id", "stage", "step_id", "rule", "detail")) == [
        ("bad", "parse", None, "parse_error", "no steps"),
        ("loop", "validation", None, "cycle", None),
        ("map", "expansion", "a", "not_expandable", "no file mapping"),
        ("refs", "dependencies", "a", "unknown_dependent", "nope"),
        ("two", "dependencies", "b", "multiple_producers", "g from a and b"),
    ]
    order = [(r.workflow_id, r.step_id, r.previous) for r in got.steps.orderBy("workflow_id", "position").collect()]
    assert order == [
        ("fine", "align_a", []), ("fine", "align_b", []), ("fine", "sum_a", ["align_a"]), ("fine", "sum_b", ["align_b"]), ("fine", "end", ["sum_a", "sum_b"]), ("none", "stays", []),
    ]


def test_ready_steps_leave_room_for_what_runs(spark):
    frame = spark.createDataFrame([("w", f"s{i}", i, t) for i, t in enumerate([2, 3, 4, 1, 1])], "workflow_id string, step_id string, ordinal int, threads int")
    none = spark.createDataFrame([], "workflow_id string, src string, dst string")
    busy = spark.createDataFrame([("w", "s0"), ("w", "s0")], "workflow_id string, step_id string")
    got = state.ready_steps(frame, none, busy.limit(0), busy, max_threads=6, max_jobs=2)
    assert sorted((r.step_id, r.taken) for r in got.collect()) == [("s1", True), ("s2", False), ("s3", True), ("s4", False)]
    got = state.ready_steps(frame, none, busy.limit(0), busy, max_threads=2, max_jobs=2)
    assert not [r for r in got.collect() if r.taken]


def test_load_reads_the_specs_once(spark):
    from pipelake.plans import load

    seen = spark.sparkContext.accumulator(0)

    def tell(step):
        seen.add(1)
        return step

    columns = STEP + ", threads int, color string, wildcard_files map<string,array<string>>"
    frame = spark.createDataFrame([("w", i, s, "t", "c", [], [], before, [], 1, None, None) for i, (s, before) in enumerate([("a", []), ("b", ["a"]), ("c", ["nope"])], 1)], columns)
    found = load.load_workflows(frame.withColumn("step_id", F.udf(tell, "string").asNondeterministic()("step_id")))
    assert [r.detail for r in found.errors.collect()] == ["nope"]
    assert found.steps.count() == 0
    assert seen.value == 3


def test_a_round_reads_only_links_that_are_left(spark, monkeypatch):
    met, write = [], graph.written

    def counted(df, name):
        found = write(df, name)
        if name == "met":
            met.append(found.count())
        return found

    monkeypatch.setattr(graph, "written", counted)
    steps = spark.createDataFrame([("w", f"s{i}", i) for i in range(5)], "workflow_id string, step_id string, ordinal int")
    links = spark.createDataFrame([("w", f"s{i}", f"s{i + 1}") for i in range(4)], "workflow_id string, src string, dst string")
    assert [r.level for r in graph.topological(steps, links).orderBy("step_id").collect()] == [0, 1, 2, 3, 4]
    assert met == [4, 3, 2, 1, 0]


def test_asymmetry_counts_rows_and_takes_null_ends_as_equal(spark):
    frame = lambda *found: spark.createDataFrame([("w", *f) for f in found], "workflow_id string, src string, dst string")
    got = edges.edge_asymmetry(frame(("a", "b"), ("a", "b"), ("x", None)), frame(("x", None), ("c", "d"), ("c", "d")))
    assert rows(got) == [("w", "a", "b", "previous")] * 2 + [("w", "c", "d", "next")] * 2


@pytest.mark.parametrize("name", ["derive_edges", "derived_counts", "edge_asymmetry", "rerun_steps", "ready_frontier", "dry_run_plan"])
def test_steps_are_numbered_once(spark, capsys, name):
    from pipelake.plans.queries import QUERIES

    QUERIES[name](spark, "/root/testdata/sf0.001").explain()
    assert "row_number" not in capsys.readouterr().out


def test_first_fit_evaluates_its_candidates_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def tell(weight):
        seen.add(1)
        return weight

    frame = spark.createDataFrame([("g", i, f"s{i}", 1) for i in range(4)], "group_id string, ordinal int, step_id string, weight int")
    found = graph.first_fit(frame.withColumn("weight", F.udf(tell, "int").asNondeterministic()("weight")).where("weight > 0"), budget=8, most=2)
    assert sum(r.taken for r in found.collect()) == 2
    assert seen.value == 4


def test_only_workflows_with_a_backward_link_go_through_rounds(spark):
    """the report took the order of all workflows to find the few with a cycle."""
    rows = [(w, f"s{i}", i) for w in (1, 2, 3, 4) for i in (1, 2, 3)] + [(5, "a", None), (5, "b", 1)]
    steps = spark.createDataFrame(rows, "workflow_id long, step_id string, ordinal int")
    links = [(1, "s1", "s2"), (1, "s2", "s3"), (1, "s9", "s1"), (2, "s2", "s1"), (2, "s1", "s2"), (3, "s3", "s1"), (3, "s1", "s2"), (4, "s2", "s2"), (5, "a", "b"), (5, "b", "a")]
    edges_ = spark.createDataFrame(links, "workflow_id long, src string, dst string")
    found = sorted((r.workflow_id, r.step_id) for r in graph.unplaced(steps, edges_).collect())
    assert found == sorted((r.workflow_id, r.step_id) for r in graph.topological(steps, edges_).where("position IS NULL").collect())
    assert {w for w, _ in found} == {2, 4, 5}
    seen = []
    inner = graph.topological
    graph.topological = lambda s, e: seen.append({r.workflow_id for r in s.collect()}) or inner(s, e)
    try:
        graph.unplaced(steps, edges_)
    finally:
        graph.topological = inner
    assert seen == [{2, 3, 4, 5}]


def test_dependencies_keep_their_places_when_only_some_expand(spark):
    """only dependencies on steps that expand are gathered; the others stay where they stood, repeats and nulls included."""
    schema = "workflow_id int, ordinal int, step_id string, command string, input array<string>, output array<string>, previous array<string>, next array<string>"
    none = []
    rows = [
        (1, 1, "t", "c", ["{n}"], none, none, ["p", "u"]),
        (1, 2, "u", "c", ["{n}"], none, ["x", "t", "x", "t", None], none),
        (1, 3, "p", "c", ["f"], none, ["x", "t", "y", "t"], ["x", "x"]),
        (1, 3, "p", "c", ["f"], none, ["x", "t", "y", "t"], ["x", "x"]),
        (1, 4, "q", "c", ["f"], none, ["b", "a", "b"], None),
    ]
    values = spark.createDataFrame([(1, "n", 0, "1"), (1, "n", 1, "2")], "workflow_id int, name string, pos int, value string")
    opened = templates.expand_templates(spark.createDataFrame(rows, schema), values)
    assert "_met" not in opened.columns
    found = sorted((r.ordinal, r.step_id, tuple(r.previous), tuple(r.next)) for r in opened.collect())
    p = (3, "p", ("x", "t_1", "t_2", "y", "t_1", "t_2"), ("x", "x"))
    assert [x for x in found if x[0] != 2] == [(1, "t_1", (), ("p", "u_1")), (1, "t_2", (), ("p", "u_2")), p, p, (4, "q", ("b", "a", "b"), ())]
    assert [x[2] for x in found if x[0] == 2] == [("x", f"t_{i}", "x", f"t_{i}", None) for i in (1, 2)]


def test_a_load_moves_small_workflows_once(spark, monkeypatch):
    """each stage of a load was a job of its own, with joins over all steps, and the order took three more for each level."""
    from pipelake.plans import load

    names, write = [], load.written
    for module in (load, graph, templates):
        monkeypatch.setattr(module, "written", lambda df, name: names.append(name) or write(df, name))
    columns = STEP + ", threads int, color string, wildcard_files map<string,array<string>>"
    frame = spark.createDataFrame([("w", i, s, "t", "c", [], [], before, [], 1, None, None) for i, (s, before) in enumerate([("a", []), ("b", ["a"]), ("c", ["b"])], 1)], columns)
    assert [r.level for r in load.load_workflows(frame).steps.orderBy("position").collect()] == [0, 1, 2]
    assert names == ["load-local"]


@pytest.mark.parametrize("name", ["load_errors", "load_steps"])
def test_what_a_load_found_is_read_without_joins(spark, capsys, name):
    """errors and steps met the other stages' tables once more when they were read."""
    from pipelake.plans.queries import QUERIES

    QUERIES[name](spark, "/root/testdata/sf0.001").explain()
    found = capsys.readouterr().out
    assert "load-local" in found and "Join" not in found and "Exchange" not in found


@pytest.mark.parametrize("mode", ["resolve", "reference"])
def test_a_local_load_equals_one_by_joins(spark, mode):
    from pipelake.plans import load

    rng = random.Random(7)
    ids = ["a", "b", "c", "d", "é", "\U0001f600", "", None, "　"]
    texts = ["x", "x, y", "y, ", "{s}", "in/{s}.{t}", "{s},{s}.b", "{u}", "{", "z", " "]
    files = ["r/a.fq", "a.fq", "b.bam", ".hid", "n/", "c", "d.x.fq", "..", None]
    some = lambda pool, most: [rng.choice(pool) for _ in range(rng.randint(0, most))]

    def workflow(w):
        odd, linked, n = rng.random() < 0.3, rng.random() < 0.6, rng.randint(1, 5)
        own = [rng.choice(ids) for _ in range(n)] if odd else rng.sample(ids[:6], n)
        pool = texts if odd else ["x", "y", "z", "{s}", "{s}.b"]
        for i, step_id in enumerate(own, 1):
            refs = lambda: (some([*own, "gone"] if odd and rng.random() < 0.2 else own, 2) if linked else []) if not odd or rng.random() < 0.95 else None  # noqa: E731, B023
            maps = {k: rng.choice([None, some(files, 3)]) for k in some(["s", "t"], 2)} if odd else {"s": some(["r/a.fq", "b.fq", "c.bam"], 3)} if rng.random() < 0.7 else None
            tool, command = rng.choice(["t", "t", "t", " \t", None] if odd else ["t"]), rng.choice(["run {s}", "go {input} {output}", "", None, "{s}"] if odd else ["run {s}", "{input}>{output}"])
            yield (w, None if odd and rng.random() < 0.1 else i, step_id, tool, command, some(pool, 2), some(pool if odd else [f"f{i}", "{s}" + f"{i}"], 2), refs(), refs() if rng.random() < 0.4 else [], i, None, maps, "broken" if odd and rng.random() < 0.05 else None)

    found = [r for w in range(400) for r in workflow(f"w{w}")] + [(None, 1, "a", "t", "c", [], [], [], [], 1, None, None, None)]
    frame = spark.createDataFrame(found, STEP + ", threads int, color string, wildcard_files map<string,array<string>>, parse_error string")
    local, joined = load.load_workflows(frame, mode), load.load_workflows(frame, mode, held=0)
    assert {tuple(r) for r in local.errors.select("stage", "rule").distinct().collect()} >= {("parse", "parse_error"), ("dependencies", "unknown_dependency"), ("dependencies", "multiple_producers"), ("expansion", "not_expandable"), ("validation", "duplicate_id"), ("validation", "cycle"), ("validation", "blank_id"), ("validation", "empty_workflow")}
    assert local.steps.columns == joined.steps.columns and local.steps.schema.simpleString() == joined.steps.schema.simpleString()
    text = lambda df: sorted(repr(tuple(r)) for r in df.collect())
    for side in ("errors", "warnings", "steps"):
        got, want = text(getattr(local, side)), text(getattr(joined, side))
        assert len(want) > 20 and got == want, side


def test_a_local_load_leaves_large_workflows_whole(spark):
    """Workflows that one task should not hold stand between small ones, over several batches; so do those that grow large when they expand."""
    from pipelake.plans import load

    columns = STEP + ", threads int, color string, wildcard_files map<string,array<string>>"
    step = lambda w, i, previous, inputs=(), files=None: (w, i, f"s{i}", "t", "c", list(inputs), [], previous, [], 1, None, files)
    wide = {"s": [f"f{k}.fq" for k in range(12)]}
    found = [step(w, i, [f"s{i - 1}"] if i else [], ["{s}"] if w % 3 == 2 else [], wide if w % 3 == 2 and not i else None) for w in range(9) for i in range(40 if w % 3 == 1 else 6)]
    frame = spark.createDataFrame([(f"w{r[0]}", *r[1:]) for r in found], columns).coalesce(1)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = load.load_workflows(frame, held=60)
        steps = got.steps.groupBy("workflow_id").agg(F.count("*").alias("n"), F.max("position").alias("last")).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert rows(got.errors) == []
    assert sorted((r.workflow_id, r.n, r.last) for r in steps) == [(f"w{w}", n, n) for w in range(9) for n in [(6, 40, 72)[w % 3]]]
