"""Helpers that several corpus operators share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Whether the shuffle files of a query go when it ends; else they stay until the driver collects its garbage.
SHUFFLES_GO = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Blanks of the word rule ``[^\x20\x09-\x0D]+``.
BLANKS = " \t\n\x0b\f\r"


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: spark.checkpoint.dir.

    Where it is unset (tests, a local session) a temporary folder takes its place.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        configured = spark.sparkContext.getCheckpointDir()
    if not configured:
        configured = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.sparkContext.setCheckpointDir(configured)
    return configured.rstrip("/")


@contextmanager
def shuffles_go(spark: SparkSession) -> Iterator[None]:
    """Queries that begin inside remove their shuffle files when they end; the session's own setting is put back."""
    before = spark.conf.get(SHUFFLES_GO, "false")
    spark.conf.set(SHUFFLES_GO, "true")
    try:
        yield
    finally:
        spark.conf.set(SHUFFLES_GO, before)


def written(df: DataFrame, name: str) -> DataFrame:
    """Write df as a table in the shared folder and return it reread.

    It cuts the lineage: the rows survive the loss of any executor and are
    never computed twice. A name of its own keeps concurrent runs apart. Once the table is there
    nothing reads the shuffles that led to it, so they go at once: operators of many written rounds would else
    hold the files of all of them.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    with shuffles_go(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only; other letters stay as they are (``lower`` would change them too)."""
    return F.translate(text, UPPER, UPPER.lower())


def blank_words(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text; null and blank text: none."""
    bare = F.btrim(F.coalesce(text, F.lit("")), F.lit(BLANKS))
    return F.when(F.length(bare) == 0, F.array().cast("array<string>")).otherwise(F.split(bare, r"[\x20\x09-\x0D]+"))


def sample_share(rows: int, bound: int) -> float:
    """Share of rows that makes a sample of about ``bound`` rows."""
    return 1.0 if rows <= bound else bound / rows


def hash_sample(key: Column, share: float) -> Column:
    """Condition that keeps about ``share`` of the keys, the same ones on every run."""
    return F.lit(True) if share >= 1.0 else F.pmod(F.xxhash64(key, F.lit(7)), F.lit(1 << 30)) < int(share * (1 << 30))


def let(value: Column, body) -> Column:
    """body(value) with value computed once: a transform over an array of one."""
    return F.get(F.transform(F.array(value), body), F.lit(0))
