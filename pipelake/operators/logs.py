"""Run logs: lines put together from output chunks that were cut anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pipelake.operators.timeline import event_parts


def log_lines(chunks: DataFrame, part_rows: int = 100_000) -> DataFrame:
    """(run_id, line_no, stream, line, ts, complete) of chunks(run_id, stream, ts, seq, data), data being bytes or text.

    A stream's chunks follow one another by (ts, seq); a line ends at a line feed (a carriage return before it goes) in whatever chunk that is, and
    characters of several bytes may be cut too. Lines of all streams of a run are numbered from 1 as they end. What a stream has
    behind its last line feed is a line that is not complete; it stands at the end, without ts. Null data is empty.

    Line feeds are counted inside written ranges of a run, and each range starts from the count of those before it, so a long run goes
    through many tasks. Nothing but the fragments of one line is ever gathered.
    """
    # One character a byte, so that any cut is at a character; bytes are read as UTF-8 once a line is whole.
    text = F.decode(F.coalesce(F.col("data").cast("binary"), F.lit(b"")), "ISO-8859-1")
    inside = event_parts(chunks.select("run_id", "stream", "ts", "seq", F.split(text, "\n", -1).alias("pieces")), part_rows)
    feeds = F.size("pieces").cast("long") - 1
    so_far = Window.partitionBy("_part", "run_id", "stream").orderBy("ts", "seq").rowsBetween(Window.unboundedPreceding, -1)
    inside = inside.withColumn("_own", F.coalesce(F.sum(feeds).over(so_far), F.lit(0)))
    earlier = Window.partitionBy("_run", "_stream").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    totals = inside.groupBy(F.col("run_id").alias("_run"), F.col("stream").alias("_stream"), F.col("_part").alias("_at")).agg(F.sum(feeds).alias("_n"))
    begun = totals.withColumn("_begin", F.coalesce(F.sum("_n").over(earlier), F.lit(0)))
    same = F.col("run_id").eqNullSafe(F.col("_run")) & F.col("stream").eqNullSafe(F.col("_stream")) & (F.col("_part") == F.col("_at"))
    opened = inside.join(begun, same).select("run_id", "stream", "ts", "seq", "_own", "_begin", F.size("pieces").alias("_k"), F.posexplode("pieces").alias("_i", "_piece"))
    ends = F.when(F.col("_i") < F.col("_k") - 1, F.struct("ts", "seq"))
    placed = opened.select("run_id", "stream", (F.col("_begin") + F.col("_own") + F.col("_i")).alias("_line"), F.struct("ts", "seq", "_piece").alias("_f"), ends.alias("_end"))
    whole = placed.groupBy("run_id", "stream", "_line").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list("_f")), lambda f: f["_piece"]), "").alias("_text"), F.max("_end").alias("_end")
    )
    whole = whole.where(F.col("_end").isNotNull() | (F.col("_text") != ""))
    line = F.make_valid_utf8(F.encode(F.regexp_replace("_text", "\r$", ""), "ISO-8859-1").cast("string"))
    number = F.row_number().over(Window.partitionBy("run_id").orderBy(F.col("_end").asc_nulls_last(), "stream", "_line"))
    return whole.select("run_id", number.cast("long").alias("line_no"), "stream", line.alias("line"), F.col("_end.ts").alias("ts"), F.col("_end").isNotNull().alias("complete"))
