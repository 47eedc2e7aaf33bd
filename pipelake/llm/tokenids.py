"""Token ids as directly addressable codes.

Documents are range-partitioned and sorted by id, encoded, and packed into segments. In a segment
each token id is cut into chunks of eight bits, lowest first. Level 0 has the first chunk of every
token; a bitmap marks the tokens that go on; level 1 has the next chunk of those alone, and so on.
A rank directory (ones before every 512 bits) finds a token's place in the next level, so any
token is read without decoding those before it.

A segment is one row of a Parquet table in the shared folder: document ids, their ends in tokens,
and the payload (layout in ``pack``). Spark's writer commits the files, so a lost executor
leaves no half-written segment behind.

Null text counts as empty: just the end id. Null document ids come first. Repeated ids keep
their rows. An empty table gives no segment.
"""

from __future__ import annotations

import json
import os
import struct
import zlib
from array import array
from collections import ChainMap
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pipelake.llm.common import written
from pipelake.llm.tokencount import byte_alphabet

MAGIC = b"DAC1"
BLOCK = 512
#: Fixed value: the pattern by which byte-level BPE of this family splits text before its merges.
PRE_TOKEN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
SEGMENT_SCHEMA = "shard int, start long, n_tokens long, doc_ids array<long>, ends array<long>, payload binary"


def pack(ids: np.ndarray) -> bytes:
    """Payload: magic, token count and level count (u8, u4), then for each level its length (u8), chunks (u1), bitmap, rank directory (u4)."""
    levels, rest = [], ids.astype(np.uint32)
    while True:
        more = rest > 0xFF
        ones = np.concatenate(([0], np.cumsum(more)))[0 : len(more) + 1 : BLOCK].astype("<u4")
        levels.append(struct.pack("<Q", len(rest)) + (rest & 0xFF).astype(np.uint8).tobytes() + np.packbits(more, bitorder="little").tobytes() + ones.tobytes())
        rest = rest[more] >> 8
        if not len(rest):
            return MAGIC + struct.pack("<QI", len(ids), len(levels)) + b"".join(levels)


@dataclass(frozen=True)
class Segment:
    """A payload opened for reading: (chunks, bitmap, rank directory) by level."""

    size: int
    levels: list[tuple[np.ndarray, np.ndarray, np.ndarray]]

    @classmethod
    def open(cls, payload: bytes) -> Segment:
        if payload[:4] != MAGIC:
            raise ValueError("not a token segment")
        size, n_levels = struct.unpack_from("<QI", payload, 4)
        at, levels = 16, []
        for _ in range(n_levels):
            (n,) = struct.unpack_from("<Q", payload, at)
            at += 8
            parts = []
            for kind, count in ((np.uint8, n), (np.uint8, -(-n // 8)), ("<u4", n // BLOCK + 1)):
                parts.append(np.frombuffer(payload, kind, count, at))
                at += parts[-1].nbytes
            levels.append(tuple(parts))
        return cls(size, levels)

    def token(self, i: int) -> int:
        """Token i, by one look-up a level."""
        if not 0 <= i < self.size:
            raise IndexError(i)
        value = shift = 0
        for chunks, bitmap, ones in self.levels:
            value |= int(chunks[i]) << shift
            if not bitmap[i >> 3] >> (i & 7) & 1:
                return value
            block = i // BLOCK
            within = np.unpackbits(bitmap[block * BLOCK // 8 : (i >> 3) + 1], bitorder="little")[: i % BLOCK]
            i, shift = int(ones[block]) + int(within.sum()), shift + 8
        return value

    def tokens(self) -> np.ndarray:
        """All tokens."""
        value = np.zeros(0, np.uint32)
        for chunks, bitmap, _ in reversed(self.levels):
            here = chunks.astype(np.uint32)
            more = np.unpackbits(bitmap, count=len(chunks), bitorder="little").astype(bool)
            here[more] |= value << np.uint32(8)
            value = here
        return value


class Encoder:
    """Token ids of texts by a byte-level BPE tokenizer, as little-endian bytes of ``kind``.

    The pre-tokenizer never joins text across a space between two non-blanks, so a text is cut at its spaces and the
    ids of each part are kept, in two generations of at most ``bound`` entries together. A new part of Latin, Greek or Cyrillic
    text is split by the pre-tokenizer's own pattern and its pre-tokens go to the BPE model; any other goes
    through the whole tokenizer. A text with a blank beside a space, or with the name of an added token, is encoded whole.
    """

    def __init__(self, model: str, bound: int = 900_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(model)
        spec = json.loads(model)
        splits = spec["pre_tokenizer"]
        if splits["type"] != "ByteLevel" or splits.get("add_prefix_space") or not splits.get("use_regex", True):
            raise ValueError("the tokenizer splits text by another rule than PRE_TOKEN")
        names = [regex.escape(t["content"]) for t in spec.get("added_tokens") or ()]
        self.named = regex.compile("|".join(names)).search if names else lambda text: None
        self.bpe = self.tokenizer.model
        self.code = "H" if self.tokenizer.get_vocab_size() <= 1 << 16 else "I"
        self.kind = "<u2" if self.code == "H" else "<u4"
        self.young: dict[str, bytes | None] = {}
        self.old: dict[str, bytes | None] = {}
        self.bound = bound // 2
        self.pre_tokens = regex.compile(PRE_TOKEN).findall
        self.stands_for = {b: c for c, b in byte_alphabet().items()}

    def _whole(self, text: str) -> bytes:
        return array(self.code, self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def _pre_token(self, token: str) -> bytes:
        mapped = "".join(map(self.stands_for.__getitem__, token.encode()))
        return array(self.code, [t.id for t in self.bpe.tokenize(mapped)]).tobytes()

    def _part(self, key: str) -> bytes | None:
        """Ids of a part, or None if it says that its text has to be encoded whole.

        The key is the text after a space; the first part of a text, which follows no space, has a zero byte before it.
        """
        first = key[:1] == "\0"
        bare = key[1:] if first else key
        if not bare:
            return b"" if first else None
        if bare[0].isspace() or bare[-1].isspace():
            return None
        word = bare if first else " " + bare
        if max(bare) >= "\u0530":
            return self._whole(word)
        tokens = self.pre_tokens(word)
        if len(tokens) == 1:
            return self._pre_token(word)
        return b"".join([self._known(t) for t in tokens])

    def _known(self, token: str) -> bytes:
        """Ids of one pre-token out of several."""
        key = token[1:] if token[0] == " " else "\0" + token
        found = self.young.get(key) or self.old.get(key) or self._pre_token(token)
        if len(token) <= 64:
            self.young[key] = found
        return found

    def encode(self, texts: list[str]) -> list[bytes]:
        cut = [[""] if "\0" in text or self.named(text) else ("\0" + text).split(" ") for text in texts]
        long: dict[str, bytes | None] = {}
        for key in set().union(*cut).difference(self.young):
            found = self.old[key] if key in self.old else self._part(key)
            (self.young if len(key) <= 64 else long)[key] = found
        known = ChainMap(long, self.young) if long else self.young
        out = []
        for text, parts in zip(texts, cut, strict=True):
            ids = [known[p] for p in parts]
            out.append(self._whole(text) if None in ids else b"".join(ids))
        if len(self.young) > self.bound:
            self.old, self.young = self.young, {}
        return out


@lru_cache(maxsize=1)
def encoder_of(model: str) -> Encoder:
    """The encoder of this Python worker; what it has learned serves the tasks to come."""
    return Encoder(model)


def encode_documents(docs: DataFrame, model: str, *, key: str = "doc_id", text: str = "text", end_id: int = 0, segment_tokens: int = 1 << 20) -> DataFrame:
    """Segments of all documents in ascending key order, not yet written.

    ``start`` counts the tokens before a segment in its shard (range partition); shards follow each other.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encoder, shard = encoder_of(shared.value), TaskContext.get().partitionId()
        end, width = np.array([end_id], dtype=encoder.kind).tobytes(), np.dtype(encoder.kind).itemsize
        ids: list[int | None] = []
        ends: list[int] = []
        held: list[bytes] = []
        size = start = 0

        def segment() -> pa.RecordBatch:
            tokens = np.frombuffer(b"".join(held), encoder.kind)
            row = {"shard": [shard], "start": [start], "n_tokens": [size], "doc_ids": [ids], "ends": [ends], "payload": [pack(tokens)]}
            kinds = (pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(row.values(), kinds, strict=True)], names=list(row))

        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                coded = encoder.encode([x or "" for x in part.column(1).to_pylist()])
                for doc_id, code in zip(part.column(0).to_pylist(), coded, strict=True):
                    held += (code, end)
                    size += len(code) // width + 1
                    ids.append(doc_id)
                    ends.append(size)
                    if size >= segment_tokens:
                        yield segment()
                        start += size
                        ids, ends, held, size = [], [], [], 0
        if ids:
            yield segment()

    ordered = docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text")).repartitionByRange("key").sortWithinPartitions("key")
    return ordered.mapInArrow(encode, SEGMENT_SCHEMA)


def write_segments(segments: DataFrame) -> DataFrame:
    """The segments, written to the shared folder and opened again."""
    return written(segments, "token-segments")


def read_documents(segments: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, decoded from written segments.

    The driver gets one row per shard, the tokens in it, to turn counts into global starts.
    """
    spark = segments.sparkSession
    before, bases = 0, []
    for row in sorted(segments.groupBy("shard").agg(F.sum("n_tokens").alias("n")).collect(), key=lambda r: r.shard):
        bases.append((row.shard, before))
        before += row.n
    bases_of = F.broadcast(spark.createDataFrame(bases, "shard int, base long"))

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                tokens = Segment.open(row["payload"]).tokens().astype("<u4")
                begins = [0, *row["ends"][:-1]]
                spans = list(zip(begins, row["ends"], strict=True))
                columns = (
                    row["doc_ids"],
                    [row["base"] + row["start"] + a for a in begins],
                    [b - a for a, b in spans],
                    [zlib.crc32(tokens[a:b].tobytes()) for a, b in spans],
                )
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    placed = segments.join(bases_of, "shard").select("base", "start", "doc_ids", "ends", "payload")
    return placed.mapInArrow(decode, "doc_id long, start long, n_tokens long, ids_crc32 long")
