"""Lifecycle events and resource samples: durations, intervals, status, usage.

Order is always (ts, seq). Milliseconds are counted from the first event of the run and truncated before subtracting.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pipelake.functions.exprs import short_label
from pipelake.operators.graph import written

KEYS = ["run_id", "step_id"]


def _terminal() -> Column:
    return F.col("event_type").isin("Completed", "Failed")


def with_run_ms(events: DataFrame) -> DataFrame:
    """events with ms since the run's first event. The origin is aggregated and joined, so a long run is not one task."""
    origin = events.groupBy("run_id").agg(F.min("ts").alias("_origin"))
    ms = F.floor((F.unix_micros("ts") - F.unix_micros("_origin")) / 1000)
    return events.join(origin, "run_id").withColumn("ms", ms).drop("_origin")


def _last_start() -> Column:
    order = Window.partitionBy(*KEYS).orderBy("ts", "seq")
    return F.last(F.when(F.col("event_type") == "Started", F.col("ms")), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))


def step_durations(events: DataFrame) -> DataFrame:
    """(run_id, step_id, duration_ms): last end less the last start before it. Steps without such a pair are absent."""
    ends = with_run_ms(events).withColumn("_start", _last_start()).where(_terminal() & F.col("_start").isNotNull())
    last = ends.groupBy(*KEYS).agg(F.max_by(F.col("ms") - F.col("_start"), F.struct("ts", "seq")).alias("duration_ms"))
    return last


def gantt_intervals(events: DataFrame, width: int = 50) -> DataFrame:
    """(run_id, step_id, start_ms, end_ms, start_pos, width, label, bar) of each step's bar.

    start is the last start, end the last end with a start before it. A bar that would not end after it starts is hidden,
    and so are all bars of a run without length.
    """
    timed = with_run_ms(events)
    total = timed.groupBy("run_id").agg(F.max("ms").alias("total"))
    marked = timed.withColumn("_start", _last_start())
    order = F.struct("ts", "seq")
    bars = marked.groupBy(*KEYS).agg(
        F.max_by(F.when(F.col("event_type") == "Started", F.col("ms")), F.when(F.col("event_type") == "Started", order)).alias("start_ms"),
        F.max_by(F.col("ms"), F.when(_terminal() & F.col("_start").isNotNull(), order)).alias("end_ms"),
    )
    shown = bars.join(total, "run_id").where("end_ms > start_ms AND total > 0")
    pos = F.floor(F.col("start_ms") * width / F.col("total"))
    wide = F.floor(F.greatest((F.col("end_ms") - F.col("start_ms")) * width / F.col("total"), F.lit(1)))
    placed = shown.withColumns({"start_pos": pos, "width": wide})
    return placed.select(
        *KEYS, "start_ms", "end_ms", "start_pos", "width", short_label(F.col("step_id").cast("string")).alias("label"),
        F.concat(F.repeat(F.lit(" "), F.col("start_pos").cast("int")), F.repeat(F.lit("#"), F.col("width").cast("int"))).alias("bar"),
    )


def step_status(steps: DataFrame, events: DataFrame) -> DataFrame:
    """(run_id, step_id, status, error) of every step: the last event's state, Pending without one.

    steps(run_id, step_id); events may carry Skipped (from a resume).
    """
    error = F.col("error") if "error" in events.columns else F.lit(None).cast("string")
    last = events.groupBy(*KEYS).agg(F.max_by(F.struct("event_type", error.alias("error")), F.struct("ts", "seq")).alias("e"))
    status = F.when(F.col("e.event_type") == "Started", "Running").otherwise(F.coalesce("e.event_type", F.lit("Pending")))
    return steps.join(last, KEYS, "left").select(*KEYS, status.alias("status"), F.when(F.col("e.event_type") == "Failed", F.col("e.error")).alias("error"))


def event_parts(events: DataFrame, part_rows: int = 100_000) -> DataFrame:
    """events with _part: ranges of (run_id, ts, seq) of about part_rows rows. Written, since a range's edges are drawn anew by each job."""
    parts = max(1, -(-events.count() // part_rows))
    return written(events.repartitionByRange(parts, "run_id", "ts", "seq").withColumn("_part", F.spark_partition_id()), "parts")


def thread_profile(events: DataFrame, part_rows: int = 100_000) -> DataFrame:
    """events(run_id, step_id, event_type, ts, seq, threads) with threads in use after each event, never below zero.

    A running sum with a floor of zero is the sum less its lowest value so far, where that is negative. Both are taken inside parts of
    a run, and each part starts from the sum and the lowest value of the parts before it, so a long run is not one task.
    """
    delta = F.when(F.col("event_type") == "Started", F.col("threads")).when(_terminal(), -F.col("threads")).otherwise(0).cast("long")
    so_far = Window.partitionBy("_part", "run_id").orderBy("ts", "seq").rowsBetween(Window.unboundedPreceding, 0)
    inside = event_parts(events, part_rows).withColumn("_delta", delta).withColumn("_sum", F.sum("_delta").over(so_far)).withColumn("_low", F.min("_sum").over(so_far))
    earlier = Window.partitionBy("_run").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    totals = inside.groupBy(F.col("run_id").alias("_run"), F.col("_part").alias("_at")).agg(F.sum("_delta").alias("_total"), F.min("_sum").alias("_least"))
    begun = totals.withColumn("_begin", F.sum("_total").over(earlier)).withColumn("_floor", F.min(F.coalesce("_begin", F.lit(0)) + F.col("_least")).over(earlier))
    placed = inside.join(begun, (F.col("_part") == F.col("_at")) & F.col("run_id").eqNullSafe(F.col("_run")))
    low = F.least(F.lit(0), F.col("_floor"), F.coalesce("_begin", F.lit(0)) + F.col("_low"))
    used = F.coalesce(F.col("_begin") + F.col("_sum"), F.col("_sum"), F.col("_begin")) - low
    return placed.select(*events.columns, used.alias("threads_in_use"))


def peak_threads(events: DataFrame) -> DataFrame:
    return thread_profile(events).groupBy("run_id").agg(F.max("threads_in_use").alias("peak_threads"))


def with_memory_mb(samples: DataFrame) -> DataFrame:
    return samples.withColumn("memory_mb", F.expr("memory_bytes DIV 1048576"))


def _next_places(t: np.ndarray, micros: int) -> np.ndarray:
    """For each sorted time, the place of the first that is at least the interval later; len(t) where there is none."""
    return np.searchsorted(t, t + micros, "left")


def _jumps(t: np.ndarray, micros: int) -> tuple[np.ndarray, np.ndarray]:
    """A range of sorted times as a function of the time accepted last before it: (starts, lasts).

    With last time L, the range's first accepted sample is the first at or after L + interval. From there the choice is fixed, and ends at
    the ``lasts`` of the first of ``starts`` that is not before it. Only starts within the interval of the range's begin can be asked for.
    """
    jump = np.minimum(_next_places(t, micros), len(t))
    final = np.where(jump == len(t), np.arange(len(t)), np.minimum(jump, len(t) - 1))
    while True:  # each pass doubles the steps taken
        further = final[final]
        if (further == final).all():
            break
        final = further
    asked = min(int(np.searchsorted(t, t[0] + micros, "left")) + 1, len(t))
    starts, lasts = t[:asked], t[final[:asked]]
    keep = np.append(lasts[1:] != lasts[:-1], True)
    return starts[keep], lasts[keep]


def thin_samples(samples: DataFrame, min_interval_ms: int = 250, part_rows: int = 100_000) -> DataFrame:
    """Samples that a sampler with a minimum interval would keep.

    The first sample of a run only starts the clock. A later one is kept if it is at least the interval after the last one
    that was accepted. Samples without a time are never kept.

    The choice is greedy, yet no run is one task: each written range of about part_rows samples is summarised as a function from the time accepted
    last before it to the one accepted last in it; a run's functions are applied one after the other; then the ranges are thinned apart, each
    from the time it now knows.
    """
    micros, schema = min_interval_ms * 1000, samples.schema
    parts = event_parts(samples.where("ts IS NOT NULL"), part_rows)

    def times(group: pa.Table) -> np.ndarray:
        return np.sort(group["_t"].to_numpy())

    def summary(key: tuple, group: pa.Table) -> pa.Table:
        starts, lasts = _jumps(times(group), micros)
        return pa.table({"run_id": [key[1]], "_part": [key[0]], "starts": pa.array([starts.tolist()], pa.list_(pa.int64())), "lasts": pa.array([lasts.tolist()], pa.list_(pa.int64()))})

    def clocks(key: tuple, group: pa.Table) -> pa.Table:
        group = group.sort_by("_part")
        last, before = None, []
        for starts, lasts in zip(group["starts"], group["lasts"], strict=True):
            before.append(last)
            begin = starts.values.to_numpy()
            place = 0 if last is None else int(np.searchsorted(begin, last + micros, "left"))
            last = int(lasts.values[place].as_py()) if place < len(begin) else last
        return pa.table({"_run": group["run_id"], "_at": group["_part"], "_last": pa.array(before, pa.int64())})

    def thin(key: tuple, group: pa.Table) -> pa.Table:
        order = pc.sort_indices(group, sort_keys=[("_t", "ascending"), ("seq", "ascending")])
        t, last = group["_t"].to_numpy()[order.to_numpy()], group["_last"][0].as_py()
        jump, kept = _next_places(t, micros), []
        place = 0 if last is None else int(np.searchsorted(t, last + micros, "left"))
        while place < len(t):
            kept.append(place)
            place = int(jump[place])
        chosen = np.array(kept[1:] if last is None else kept, np.int64)
        return group.select(schema.names).take(pa.array(order.to_numpy()[chosen]))

    timed = parts.withColumn("_t", F.unix_micros("ts"))
    run = schema["run_id"].dataType.simpleString()
    functions = timed.select("_part", "run_id", "_t").groupBy("_part", "run_id").applyInArrow(summary, f"run_id {run}, _part int, starts array<long>, lasts array<long>")
    known = written(functions.groupBy("run_id").applyInArrow(clocks, f"_run {run}, _at int, _last long"), "clocks")
    met = timed.join(known, F.col("run_id").eqNullSafe(F.col("_run")) & (F.col("_part") == F.col("_at")))
    return met.select("_part", *schema.names, "_t", "_last").groupBy("_part", "run_id").applyInArrow(thin, schema)


def thin_long_runs(samples: DataFrame, min_interval_ms: int = 250) -> DataFrame:
    """The same; kept for callers of the older name."""
    return thin_samples(samples, min_interval_ms)


def resource_summary(samples: DataFrame, runs: DataFrame | None = None) -> DataFrame:
    """(run_id, samples, avg_cpu, peak_mb, min_mb, text) per run; zeros and a remark for runs without samples."""
    found = with_memory_mb(samples).groupBy("run_id").agg(F.count("*").alias("samples"), F.avg("cpu").alias("avg_cpu"), F.max("memory_mb").alias("peak_mb"), F.min("memory_mb").alias("min_mb"))
    found = found if runs is None else runs.select("run_id").distinct().join(found, "run_id", "left")
    text = F.format_string("CPU %.1f%%, memory %d to %d MB, %d samples", "avg_cpu", "min_mb", "peak_mb", "samples")
    found = found.na.fill(0).na.fill(0.0)
    return found.withColumn("text", F.when(F.col("samples") > 0, text).otherwise("No resource data collected"))


def run_elapsed(events: DataFrame) -> DataFrame:
    """(run_id, elapsed_ms) from first to last event."""
    return events.groupBy("run_id").agg(F.floor((F.unix_micros(F.max("ts")) - F.unix_micros(F.min("ts"))) / 1000).alias("elapsed_ms"))
