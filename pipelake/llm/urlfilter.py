"""URL filters: prefix rules first, then exact host membership by a Bloom filter cascade.

The cascade answers "is this key listed?" without a join and without error for
every key of a closed universe. Level 0 encodes the listed keys. Level 1 encodes
the unlisted keys that level 0 lets through, level 2 the listed keys that level 1
lets through, and so on until a level lets nothing wrong through. A key's answer is
the parity of the first level that rejects it.

The filters of a cascade that a task holds stay under a bound of bytes. Where all keys would need more, they are dealt out by hash, each part has a
cascade of its own, and the parts are looked up one after the other.

Nulls and odd input: a null url, or one without ``://``, has empty host and path, fits
no rule and is allowed. An empty listed set blocks nothing. Extra columns pass through, whatever their names.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pipelake.llm.common import UPPER, written


@dataclass(frozen=True)
class Rule:
    """A host (with its subdomains) and the start of the path."""

    action: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


def url_host(url: Column) -> Column:
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"\A(?s:.*?)://([^/?#]*)", 1)
    return F.translate(rest, UPPER, UPPER.lower())


def url_path(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"\A(?s:.*?)://[^/?#]*([^?#]*)", 1)


def longest_rule(host: Column, path: Column, rules: tuple[Rule, ...]) -> Column:
    """Struct (text, action) of the longest rule that fits, or null.

    Of rules with equal length the first in (text, action) order wins.
    """
    found = F.lit(None).cast("struct<text:string,action:string>")
    for rule in sorted(rules, key=lambda r: (-len(r.text), r.text, r.action), reverse=True):
        fits = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)
        found = F.when(fits, F.struct(F.lit(rule.text).alias("text"), F.lit(rule.action).alias("action"))).otherwise(found)
    return found


@dataclass(frozen=True)
class Level:
    """One Bloom filter: 64-bit words and the number of probes."""

    words: np.ndarray
    probes: int

    @property
    def bits(self) -> int:
        return len(self.words) * 64


#: Words of a filter in one block, the most parts that keys are dealt out to, and the least bound of a part's filters.
BLOCK, MOST_PARTS, LEAST_BYTES = 1 << 13, 1 << 12, 64


class CascadeTooLarge(ValueError):
    """The filters would exceed the broadcast bound."""


def _hashes(key: Column, level: int) -> tuple[Column, Column]:
    """Two 31-bit numbers; small enough that first + i * step never overflows a long."""
    low = F.lit(0x7FFFFFFF)
    return F.xxhash64(key, F.lit(2 * level)).bitwiseAND(low), F.xxhash64(key, F.lit(2 * level + 1)).bitwiseAND(low)


def _level(keys: DataFrame, level: int, count: int, bits_per_key: float, max_bytes: int) -> Level:
    """Build one filter: executors OR their bits together into blocks, the driver gets those (at most max_bytes)."""
    n_words = max(1, math.ceil(count * bits_per_key / 64))
    if n_words * 8 > max_bytes:
        raise CascadeTooLarge(f"level {level} needs {n_words * 8} bytes; the bound is {max_bytes}")
    probes = max(1, round(bits_per_key * math.log(2)))
    first, step = _hashes(F.col("key"), level)
    places = F.array(*[F.pmod(first + F.lit(i) * step, F.lit(n_words * 64)) for i in range(probes)])
    by_word = keys.select(F.explode(places).alias("bit")).groupBy(F.floor(F.col("bit") / 64).alias("word"))
    found = by_word.agg(F.bit_or(F.expr("shiftleft(1L, CAST(bit % 64 AS INT))")).alias("bits")).withColumn("block", F.floor(F.col("word") / BLOCK))

    def packed(key: tuple, group: pa.Table) -> pa.Table:
        block = np.zeros(BLOCK, np.int64)
        block[group["word"].to_numpy() - key[0].as_py() * BLOCK] = group["bits"].to_numpy()
        return pa.table({"block": pa.array([key[0].as_py()], pa.int64()), "words": pa.array([block.tobytes()], pa.binary())})

    words = np.zeros(-(-n_words // BLOCK) * BLOCK, np.uint64)
    for row in found.groupBy("block").applyInArrow(packed, "block long, words binary").collect():
        words[row.block * BLOCK : (row.block + 1) * BLOCK] = np.frombuffer(row.words, np.uint64)
    return Level(words[:n_words], probes)


def _passes(level: Level, first: np.ndarray, step: np.ndarray) -> np.ndarray:
    """Which keys the filter lets through."""
    ok = np.ones(len(first), dtype=bool)
    for i in range(level.probes):
        place = np.mod(first + np.int64(i) * step, np.int64(level.bits)).astype(np.uint64)
        ok &= (level.words[place >> np.uint64(6)] >> (place & np.uint64(63))) & np.uint64(1) == 1
    return ok


def rejecting_level(levels: list[Level], key: Column, spark) -> Column:
    """Number of the first level that rejects the key; len(levels) if all let it through."""
    shared = spark.sparkContext.broadcast(levels)

    @F.pandas_udf("int")
    def walk(pairs: Iterator[pd.DataFrame]) -> Iterator[pd.Series]:
        for frame in pairs:
            out = np.full(len(frame), len(shared.value), dtype=np.int32)
            going = np.ones(len(frame), dtype=bool)
            for i, level in enumerate(shared.value):
                ok = _passes(level, frame[f"a{i}"].to_numpy(), frame[f"b{i}"].to_numpy())
                out[going & ~ok] = i
                going &= ok
            yield pd.Series(out)

    parts = []
    for i in range(len(levels)):
        first, step = _hashes(key, i)
        parts += [first.alias(f"a{i}"), step.alias(f"b{i}")]
    return walk(F.struct(*parts))


def build_cascade(keys: DataFrame, *, first_bits: float = 10.0, next_bits: float = 4.0, max_bytes: int = 64 << 20) -> list[Level]:
    """Fit the levels on a universe ``keys(key, listed)`` with distinct keys.

    The filters of all levels together stay under max_bytes, the bound of what is
    broadcast; beyond it CascadeTooLarge is raised and the caller takes fewer keys.
    """
    spark = keys.sparkSession
    levels: list[Level] = []
    room = max_bytes
    while True:
        i = len(levels)
        alive = keys if i == 0 else keys.where(rejecting_level(levels, F.col("key"), spark) == i)
        encode = alive.where(F.col("listed") == (i % 2 == 0))
        count = encode.count()
        if count == 0:
            return levels
        levels.append(_level(encode, i, count, first_bits if i == 0 else next_bits, room))
        room -= len(levels[-1].words) * 8


def listed_by_cascade(df: DataFrame, key: Column, universe: DataFrame, *, max_bytes: int = 64 << 20) -> tuple[DataFrame, Column]:
    """df and a boolean column: is key listed in ``universe(key, listed)``?

    Every non-null key of df has to be in the universe. Null and unknown keys: see the module. Keys that one cascade under max_bytes cannot hold are
    dealt out by hash: each part of df is looked up by its own cascade and written, so no more than one is held at a time.
    """
    if max_bytes < LEAST_BYTES:
        raise CascadeTooLarge(f"a bound below {LEAST_BYTES} bytes holds no cascade")
    spark = df.sparkSession
    # Ten bits a listed key, and half as much again for the later levels; more parts where that is not enough.
    parts = max(1, math.ceil(universe.where("listed").count() * 10 / 8 * 1.5 / max_bytes))
    while True:
        part_of = lambda k: F.pmod(F.xxhash64(k, F.lit(-1)), F.lit(parts))  # noqa: B023, E731
        name, found = f"_listed_{uuid.uuid4().hex}", None
        try:
            for part in range(parts):
                keys = universe if parts == 1 else universe.where(part_of(F.col("key")) == part)
                levels = build_cascade(keys, max_bytes=max_bytes)
                listed = rejecting_level(levels, key, spark) % 2 == 1 if levels else F.lit(False)
                if parts == 1:
                    return df, listed
                here = written(df.where(part_of(key) == part).withColumn(name, listed), "listed")
                found = here if found is None else found.union(here)
            return found, F.col(name)
        except CascadeTooLarge:
            if parts >= MOST_PARTS:
                raise
            parts *= 2


def judge_urls(pages: DataFrame, rules: tuple[Rule, ...], listed: Column | DataFrame, *, url: str = "url", max_bytes: int = 64 << 20) -> DataFrame:
    """Add host, path, rule and verdict to pages.

    ``listed`` says which hosts of the corpus are on the block list: a condition over a column ``key`` (a host), or a table with such a column,
    which may name hosts that the corpus has not. The prefix rules win over the list. Columns of pages named host, path, rule or verdict are replaced.
    """
    hosts = pages.select(url_host(F.col(url)).alias("key")).where("key <> ''").distinct()
    if isinstance(listed, DataFrame):
        marked = listed.select("key", F.lit(True).alias("listed")).distinct()
        universe = hosts.join(marked, "key", "left").select("key", F.coalesce("listed", F.lit(False)).alias("listed"))
    else:
        universe = hosts.select("key", F.coalesce(listed, F.lit(False)).alias("listed"))
    packed = pages.select(F.struct(*[F.col(f"`{c}`") for c in pages.columns]).alias("page"), url_host(F.col(url)).alias("host"), url_path(F.col(url)).alias("path"))
    split, blocked = listed_by_cascade(packed, F.col("host"), written(universe, "url-universe"), max_bytes=max_bytes)
    found = split.select("page", "host", "path", (blocked & (F.col("host") != "")).alias("blocked"), longest_rule(F.col("host"), F.col("path"), rules).alias("best"))
    verdict = F.coalesce(F.col("best.action"), F.when(F.col("blocked"), "block").otherwise("allow"))
    kept = [F.col(f"page.`{c}`") for c in pages.columns if c not in ("host", "path", "rule", "verdict")]
    return found.select(*kept, "host", "path", F.col("best.text").alias("rule"), verdict.alias("verdict"))
