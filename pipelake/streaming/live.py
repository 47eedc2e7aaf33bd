"""The batch operators over live streams. Each gives the batch result once its input is complete."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from pipelake.functions.exprs import log_severity
from pipelake.operators.timeline import with_memory_mb
from pipelake.streaming.tables import UpsertTable, newest


def live_status(events: DataFrame) -> DataFrame:
    """(run_id, step_id, status, error): the state after each step's last event. Update mode."""
    last = events.groupBy("run_id", "step_id").agg(F.max_by(F.struct("event_type", "error"), F.struct("ts", "seq")).alias("e"))
    return last.select("run_id", "step_id", F.when(F.col("e.event_type") == "Started", "Running").otherwise(F.col("e.event_type")).alias("status"), F.when(F.col("e.event_type") == "Failed", F.col("e.error")).alias("error"))


def upsert_into(path: str, keys: list[str], buckets: int = 16):
    """A foreachBatch sink that keeps the newest row per key in an UpsertTable."""

    def write(batch: DataFrame, number: int) -> None:
        UpsertTable(batch.sparkSession, path, keys, newest(keys), buckets).upsert(batch, number)

    return write


def read_upserts(spark: SparkSession, path: str, keys: list[str], schema) -> DataFrame:
    """The rows that upsert_into keeps, as of its last whole batch."""
    return UpsertTable(spark, path, keys, newest(keys)).read(schema)


#: Keys are dealt into so many buckets; a bucket is one group of state, so a batch costs state calls by bucket and not by key.
BUCKETS = 1024


def _by_bucket(rows: DataFrame, *keys: str):
    return rows.withColumn("bucket", F.pmod(F.xxhash64(*keys), F.lit(BUCKETS)).cast("int")).groupBy("bucket")


class _InTimeOrder(StatefulProcessor):
    """Rows of a bucket of keys held until the watermark has passed them, then given to ``take`` in order of (us, seq).

    Each input frame becomes one sorted entry of a list state; a timer at the earliest waiting row releases what the watermark has
    passed. Held are only rows between the watermark and the newest ones. ``columns`` begin with the ``keys`` and end with us and seq. The
    values of the bucket's keys are one entry of state, an Arrow table of ``state``.
    """

    keys: int
    columns: list[str]
    out: list[str]
    state: pa.Schema

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "rows binary")
        self.values = handle.getValueState("values", "rows binary")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        first = None
        for frame in rows:
            frame = frame[self.columns].sort_values(["us", "seq"], kind="stable", ignore_index=True)
            self.waiting.appendValue((_ipc(frame),))
            first = min(x for x in (first, int(frame["us"].iloc[0])) if x is not None)
        if first is not None:
            self._wake(first)
        yield pd.DataFrame(columns=self.out)

    def _wake(self, us: int) -> None:
        # A timer fires once the watermark is past it; the row itself is due when the watermark is at its millisecond. Timers below zero never fire.
        self.handle.registerTimer(max(us // 1000 - 1, 0))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        due = (timerValues.getCurrentWatermarkInMs() + 1) * 1000
        held = [_frame(r[0]) for r in self.waiting.get()] if self.waiting.exists() else []
        cuts = [int(f["us"].searchsorted(due)) for f in held]
        later = [f.iloc[c:] for f, c in zip(held, cuts, strict=True) if c < len(f)]
        ready = [f.iloc[:c] for f, c in zip(held, cuts, strict=True) if c]
        self.waiting.clear()
        if later:
            rest = pd.concat(later, ignore_index=True).sort_values(["us", "seq"], kind="stable", ignore_index=True)
            self.waiting.appendValue((_ipc(rest),))
            self._wake(int(rest["us"].iloc[0]))
        values = self._load() if self.values.exists() else {}
        found: list[tuple] = []
        if ready:
            found = self.take(pd.concat(ready, ignore_index=True).sort_values(["us", "seq"], kind="stable"), values)
        yield pd.DataFrame(found, columns=self.out)
        values = self.kept(values, due)
        self.values.update((self._stored(values),)) if values else self.values.clear()

    def _load(self) -> dict[tuple, tuple]:
        rows = zip(*[c.to_pylist() for c in pa.ipc.open_stream(self.values.get()[0]).read_all().columns], strict=True)
        return {row[: self.keys]: row[self.keys :] for row in rows}

    def _stored(self, values: dict[tuple, tuple]) -> bytes:
        columns = zip(*[(*key, *value) for key, value in values.items()], strict=True)
        return _stream_of(pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(columns, self.state, strict=True)], schema=self.state))

    def take(self, rows: pd.DataFrame, values: dict[tuple, tuple]) -> list[tuple]:
        """Rows out after the rows, which are in order; ``values`` of their keys are changed in place."""
        raise NotImplementedError

    def kept(self, values: dict[tuple, tuple], due: int) -> dict[tuple, tuple]:
        return values

    def close(self) -> None:
        pass


def _ipc(frame: pd.DataFrame) -> bytes:
    return _stream_of(pa.Table.from_pandas(frame, preserve_index=False))


def _stream_of(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as writer:
        writer.write_table(table)
    return sink.getvalue().to_pybytes()


def _frame(data: bytes) -> pd.DataFrame:
    return pa.ipc.open_stream(data).read_pandas()


class _Durations(_InTimeOrder):
    """Per (run, step): the last start; an end with a start gives a duration. A start is forgotten ``expire_ms`` after it."""

    keys, columns, out = 2, ["run_id", "step_id", "event_type", "us", "seq"], ["run_id", "step_id", "start_us", "us", "seq"]
    state = pa.schema([("run_id", pa.string()), ("step_id", pa.string()), ("start_us", pa.int64())])

    def __init__(self, expire_ms: int | None):
        self.expire_ms = expire_ms

    def take(self, rows: pd.DataFrame, values: dict[tuple, tuple]) -> list[tuple]:
        found = []
        for run, step, kind, us, seq in rows.itertuples(index=False, name=None):
            if kind == "Started":
                values[run, step] = (int(us),)
            elif kind in ("Completed", "Failed") and (run, step) in values and not self.old(start := values[run, step][0], us):
                found.append((run, step, start, int(us), int(seq)))
        return found

    def old(self, start: int, us: int) -> bool:
        return self.expire_ms is not None and us - start > self.expire_ms * 1000

    def kept(self, values: dict[tuple, tuple], due: int) -> dict[tuple, tuple]:
        if self.expire_ms is None:
            return values
        values = {key: value for key, value in values.items() if not self.old(value[0], due)}
        if values:
            self.handle.registerTimer(min(value[0] for value in values.values()) // 1000 + self.expire_ms)
        return values


def live_durations(events: DataFrame, origin: str = "1970-01-01 00:00:00", late: str = "10 minutes", expire_ms: int | None = 30 * 86_400_000) -> DataFrame:
    """(run_id, step_id, duration_ms, us, seq) at each end; the last row of a step is its batch duration.

    Events may arrive in any order within ``late``; they count once the watermark has reached them, and what comes at or before it afterwards is dropped. Milliseconds
    count from ``origin`` (give the run's start for the batch result to the millisecond). Starts are kept ``expire_ms`` (None: for ever). Append
    mode; needs the RocksDB state store.
    """
    timed = events.withWatermark("ts", late).select("run_id", F.col("step_id").cast("string").alias("step_id"), "event_type", F.unix_micros("ts").alias("us"), "seq", "ts")
    found = _by_bucket(timed, "run_id", "step_id").transformWithStateInPandas(_Durations(expire_ms), "run_id string, step_id string, start_us long, us long, seq long", "Append", "EventTime")
    ms = lambda c: F.floor((F.col(c) - F.unix_micros(F.to_timestamp(F.lit(origin)))) / 1000)
    return found.select("run_id", "step_id", (ms("us") - ms("start_us")).alias("duration_ms"), "us", "seq")


class _Thinning(_InTimeOrder):
    """Per run: the time of the last accepted sample. The first sample only starts the clock."""

    keys, columns, out = 1, ["run_id", "cpu", "memory_mb", "us", "seq"], ["run_id", "seq", "us", "cpu", "memory_mb"]
    state = pa.schema([("run_id", pa.string()), ("us", pa.int64())])

    def __init__(self, micros: int):
        self.micros = micros

    def take(self, rows: pd.DataFrame, values: dict[tuple, tuple]) -> list[tuple]:
        found = []
        for run, cpu, memory, us, seq in rows.itertuples(index=False, name=None):
            last = values.get((run,))
            ok = last is not None and us - last[0] >= self.micros
            if ok or last is None:
                values[run,] = (int(us),)
            if ok:
                found.append((run, seq, us, cpu, memory))
        return found


def live_thinning(samples: DataFrame, min_interval_ms: int = 250, late: str = "1 minute") -> DataFrame:
    """Samples that a sampler with a minimum interval keeps, in any order of arrival within ``late``; append mode, RocksDB state store."""
    rows = with_memory_mb(samples).withWatermark("ts", late)
    rows = rows.select(F.col("run_id").cast("string").alias("run_id"), "seq", F.unix_micros("ts").alias("us"), "cpu", "memory_mb", "ts")
    return _by_bucket(rows, "run_id").transformWithStateInPandas(_Thinning(min_interval_ms * 1000), "run_id string, seq long, us long, cpu double, memory_mb long", "Append", "EventTime")


class _Lines(_InTimeOrder):
    """Per run: the number of the next line, and what each stream has behind its last line feed."""

    keys, columns, out = 1, ["run_id", "stream", "data", "us", "seq"], ["run_id", "line_no", "stream", "line", "us"]
    state = pa.schema([("run_id", pa.string()), ("next", pa.int64()), ("rest", pa.list_(pa.struct([("stream", pa.string()), ("data", pa.binary())])))])

    def take(self, rows: pd.DataFrame, values: dict[tuple, tuple]) -> list[tuple]:
        found = []
        open_rests: dict[str, dict] = {}
        for run, stream, data, us, _ in rows.itertuples(index=False, name=None):
            number, rest = values.get((run,), (1, []))
            rest = open_rests.setdefault(run, {r["stream"]: r["data"] for r in rest})
            *lines, last = (data or b"").split(b"\n")
            if lines:
                lines[0] = rest.pop(stream, b"") + lines[0]
                rest[stream] = last
            else:
                rest[stream] = rest.get(stream, b"") + last
            for line in lines:
                found.append((run, number, stream, line.removesuffix(b"\r").decode(errors="replace"), int(us)))
                number += 1
            values[run,] = (number, [])
        for run, rest in open_rests.items():
            values[run,] = (values[run,][0], [{"stream": k, "data": v} for k, v in rest.items()])
        return found


def live_log_lines(chunks: DataFrame, late: str = "10 seconds") -> DataFrame:
    """(run_id, line_no, stream, line, us): the complete lines of chunks(run_id, stream, ts, seq, data), as logs.log_lines numbers them.

    The rest behind a stream's last line feed is carried from batch to batch. Chunks may arrive in any order within ``late``. Append mode, RocksDB
    state store.
    """
    timed = chunks.withWatermark("ts", late)
    rows = timed.select(F.col("run_id").cast("string").alias("run_id"), "stream", F.col("data").cast("binary").alias("data"), F.unix_micros("ts").alias("us"), "seq", "ts")
    return _by_bucket(rows, "run_id").transformWithStateInPandas(_Lines(), "run_id string, line_no long, stream string, line string, us long", "Append", "EventTime")


def live_resources(samples: DataFrame, window: str = "1 minute", late: str = "10 minutes") -> DataFrame:
    """Per run and window: samples, average CPU, peak and lowest memory. Samples later than ``late`` are dropped by the watermark."""
    timed = with_memory_mb(samples).withWatermark("ts", late)
    return timed.groupBy("run_id", F.window("ts", window)).agg(F.count("*").alias("samples"), F.avg("cpu").alias("avg_cpu"), F.max("memory_mb").alias("peak_mb"), F.min("memory_mb").alias("min_mb"))


def live_severity(log: DataFrame) -> DataFrame:
    """(run_id, severity, lines). Complete or update mode."""
    return log.groupBy("run_id", log_severity(F.col("line")).alias("severity")).agg(F.count("*").alias("lines"))


SNAPSHOT = "workflow_id {0}, part string, step_id string, at struct<ts:timestamp,seq:bigint,event_type:string,step_id:string>"


def snapshot_parts(events: DataFrame) -> DataFrame:
    """State in a form that merges: per workflow its last clear, its last event, and each step's last completion, with their times."""
    at = F.struct("ts", F.col("seq").cast("long").alias("seq"), "event_type", F.col("step_id").cast("string").alias("step_id"))
    kind = F.col("event_type")
    parts = F.array(F.lit("last"), F.when(kind == "Cleared", "clear").when(kind == "Completed", "done"))
    opened = events.select("workflow_id", F.explode(F.array_compact(parts)).alias("part"), at.alias("at"))
    step = F.when(F.col("part") == "done", F.col("at.step_id"))
    return opened.groupBy("workflow_id", "part", step.alias("step_id")).agg(F.max("at").alias("at"))


def merge_parts(stored: DataFrame, batch: DataFrame) -> DataFrame:
    """The parts of both, maxima part by part: in any order, and any number of times. Completions before the last clear go."""
    keys = ["workflow_id", "part", "step_id"]
    both = stored.select(*keys, "at").union(batch.select(*keys, "at")).groupBy(*keys).agg(F.max("at").alias("at"))
    cleared = both.where("part = 'clear'").select(F.col("workflow_id").alias("_w"), F.struct("at.ts", "at.seq").alias("_clear"))
    met = both.join(cleared, F.col("workflow_id").eqNullSafe(F.col("_w")), "left")
    live = F.col("_clear").isNull() | (F.col("part") != "done") | (F.struct("at.ts", "at.seq") > F.col("_clear"))
    return met.where(live).select(*keys, "at")


def folded_parts(parts: DataFrame) -> DataFrame:
    """(workflow_id, completed, failed_step, updated_at, is_resume), as state_fold gives them."""
    last = F.max(F.when(F.col("part") == "last", F.col("at")))
    folded = parts.groupBy("workflow_id").agg(F.array_sort(F.collect_list(F.when(F.col("part") == "done", F.col("step_id")))).alias("completed"), last.alias("_last"))
    failed = F.when(F.col("_last.event_type") == "Failed", F.col("_last.step_id")).alias("failed_step")
    folded = folded.select("workflow_id", "completed", failed, F.col("_last.ts").alias("updated_at"))
    return folded.withColumn("is_resume", (F.size("completed") > 0) | F.col("failed_step").isNotNull())


def _snapshots(spark: SparkSession, path: str, buckets: int) -> UpsertTable:
    return UpsertTable(spark, path, ["workflow_id"], merge_parts, buckets)


def start_snapshots(events: DataFrame, path: str, checkpoint: str, buckets: int = 16) -> StreamingQuery:
    """Keep a state snapshot per workflow up to date.

    A batch's Completed, Failed and Cleared events are reduced to snapshot parts and merged into those stored before, in the buckets of its
    workflows; no event is read twice, whatever came before. Replaying a batch, or events that come late, repeated or in another order, give the
    same snapshot.
    """

    def fold(batch: DataFrame, number: int) -> None:
        _snapshots(batch.sparkSession, path, buckets).upsert(snapshot_parts(batch), number)

    return events.writeStream.foreachBatch(fold).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_snapshots(spark: SparkSession, path: str, key_type: str = "string") -> DataFrame:
    """The snapshots that start_snapshots keeps; key_type is the type of workflow_id."""
    return folded_parts(_snapshots(spark, path, 1).read(SNAPSHOT.format(key_type)))


def run_to_table(stream: DataFrame, checkpoint: str, mode: str = "append") -> DataFrame:
    """Run a stream over all that is there and return its rows; for tests and small results."""
    name = f"live_{uuid.uuid4().hex}"
    stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return stream.sparkSession.table(name)
