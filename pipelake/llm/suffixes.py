r"""Exact removal of repeated byte strings by a distributed difference-cover suffix order.

A byte goes when it lies in a string of ``length`` bytes that also starts earlier: in a document with a smaller id, or
further left in the same one. Strings overlap freely, never cross documents, and are judged on the input.

The difference cover D of period v holds, for any two positions i and j, a shift d < v with i + d and j + d both in D
(v = 3, D = {1, 2} is the textbook's; the longer the strings, the longer the period: 31 for 100 bytes, six positions in 31). Only the
first ``length`` bytes of a suffix count here, so the recursion ends after one level:

1. *Sample.* The suffixes at positions of D are named by their first length - v + 1 bytes. Names are sorted; one that no
   other suffix has is dropped, since no repeat can hold it.
2. *Recurse on the names.* Triples of names a period apart are named and sorted again. A sampled suffix whose triple also starts
   earlier settles all strings inside the triple: each of them starts earlier too.
3. *Merge.* The remaining suffixes, those near a sampled repeat that no triple settles, are sorted by their first
   ``length`` bytes together with the first occurrences, and neighbours with equal prefixes are compared: all but the earliest go.

A name is a hash of the bytes it stands for: equal prefixes sort together, which is all that steps 1 to 3 ask of an order. Step 1's may clash
(that only adds candidates); those that decide have 96 bits, so among 10^12 different strings two clash with a chance of 10^-5.

What moves is packed. Documents are written as compressed chunks; a task names the suffixes of a chunk, settles those that
meet inside it, and sends one array per chunk and bucket. A passage that every document repeats costs a bucket one entry per chunk. The
number of buckets follows from the bytes of text, so a bucket's arrays stay of one size at any input.

Null and empty texts have no bytes to remove. Rows with a null id are neither references nor changed. Rows with equal ids are
one document as far as "earlier" goes: only a start further left counts between them. An empty table gives an empty result.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pipelake.llm.common import written
from pipelake.llm.hashing import mixed
from pipelake.llm.packing import pack, unpack

#: Perfect difference sets: every difference modulo the period occurs. Fixed values.
COVERS = {3: (1, 2), 7: (1, 2, 4), 13: (0, 1, 3, 9), 31: (1, 5, 11, 24, 25, 27)}
#: Bytes of text that one bucket's entries stand for.
BUCKET_BYTES = 16 << 20
_K1, _K2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


class Cover:
    """The difference cover for strings of ``length`` bytes."""

    def __init__(self, length: int):
        if length < 10:
            raise ValueError("strings shorter than 10 bytes are not supported")
        self.length = length
        self.period = max(v for v in COVERS if 3 * v <= length)
        self.span = length - self.period + 1
        self.triple = 2 * self.period + self.span
        self.member = np.isin(np.arange(self.period), COVERS[self.period])


class Chunk:
    """Documents of one task, end to end: ids, lengths and bytes."""

    def __init__(self, ids: np.ndarray, known: np.ndarray, lengths: np.ndarray, data: bytes):
        self.ids, self.known, self.lengths, self.data = ids, known.astype(bool), lengths, data
        self.ends = np.cumsum(lengths)
        self.starts = self.ends - lengths
        self.n = len(data)
        # Eight bytes from each position, as one number.
        self.words = np.ndarray((self.n + 1,), "<u8", buffer=data + bytes(8), strides=(1,))

    @staticmethod
    def packed(ids: list[int | None], texts: list[bytes]) -> bytes:
        known = np.array([i is not None for i in ids], np.uint8)
        head = pack(np.array([i or 0 for i in ids], np.int64), known, np.array([len(t) for t in texts], np.int64))
        return struct.pack("<Q", len(head)) + head + zstandard.compress(b"".join(texts), 3)

    @classmethod
    def read(cls, blob: bytes) -> Chunk:
        (size,) = struct.unpack_from("<Q", blob)
        head = unpack(blob[8 : 8 + size])
        return cls(*head, zstandard.decompress(blob[8 + size :]))

    @cached_property
    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.lengths), dtype=np.int32), self.lengths)

    @cached_property
    def place(self) -> np.ndarray:
        """Of each byte in its document."""
        return np.arange(self.n, dtype=np.int64) - np.repeat(self.starts, self.lengths)

    @cached_property
    def left(self) -> np.ndarray:
        """Bytes from each position to the end of its document; 0 where the document has no id."""
        left = np.repeat(self.ends, self.lengths) - np.arange(self.n, dtype=np.int64)
        return np.where(np.repeat(self.known, self.lengths), left, 0)

    def samples(self, cover: Cover) -> np.ndarray:
        """Positions of the cover that lie in some string of the right length."""
        fit = cover.member[self.place % cover.period] & (self.left >= cover.span) & (self.left + self.place >= cover.length)
        return np.flatnonzero(fit)

    def names(self, at: np.ndarray, span: int, *, both: bool = True) -> tuple[np.ndarray, np.ndarray]:
        """Two hashes of the ``span`` bytes from each position, 64 and 32 bits."""
        high, low = np.zeros(len(at), np.uint64), np.zeros(len(at), np.uint64)
        for a in range(0, len(at), 1 << 15):  # in pieces that stay in the cache
            here, h, g = at[a : a + (1 << 15)], high[a : a + (1 << 15)], low[a : a + (1 << 15)]
            for o in [*range(0, span - 8, 8), span - 8]:
                word = self.words[here + o]
                h += word
                h *= _K1
                h ^= h >> np.uint64(29)
                if both:
                    g ^= word
                    g *= _K2
                    g ^= g >> np.uint64(31)
        return mixed(high), (mixed(low) >> np.uint64(32)).astype(np.uint32)

    def near(self, hits: np.ndarray, cover: Cover) -> np.ndarray:
        """Mask of the strings that hold a sampled repeat."""
        return self._covered(np.maximum(hits - (cover.period - 1), 0), hits + 1) & (self.left >= cover.length)

    def settled(self, triples: np.ndarray, cover: Cover) -> np.ndarray:
        """Mask of the strings inside a triple that starts earlier."""
        return self._covered(triples, triples + cover.triple - cover.length + 1)

    def _covered(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        edge = np.zeros(self.n + 1, np.int32)
        np.add.at(edge, begin, 1)
        np.add.at(edge, end, -1)
        return np.cumsum(edge)[:-1] > 0


def _steps(at: np.ndarray) -> np.ndarray:
    return np.diff(at, prepend=0).astype(np.uint32)


def _unsteps(steps: np.ndarray) -> np.ndarray:
    return np.cumsum(steps, dtype=np.int64)


def _repeated(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order by the key, and whether each entry in that order has an equal one."""
    order = np.argsort(key, kind="stable")
    equal = key[order][1:] == key[order][:-1]
    twice = np.zeros(len(key), bool)
    twice[1:] = equal
    twice[:-1] |= equal
    return order, twice


def _later(high: np.ndarray, low: np.ndarray, ids: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Whether each string's equal also starts at a smaller (id, place): equal strings are neighbours once sorted."""
    later = np.zeros(len(high), bool)
    order, twice = _repeated(high)
    some = order[twice]
    some = some[np.lexsort((place[some], ids[some], low[some], high[some]))]
    new = np.ones(len(some), bool)
    new[1:] = (high[some][1:] != high[some][:-1]) | (low[some][1:] != low[some][:-1])
    if len(some):
        lead = some[new][np.cumsum(new) - 1]
        later[some] = (ids[some] != ids[lead]) | (place[some] != place[lead])
    return later


def _deal(bucket: np.ndarray, buckets: int) -> Iterator[tuple[int, np.ndarray]]:
    """(bucket, its entries), entries in their order."""
    order = np.argsort(bucket.astype(np.uint16 if buckets <= 1 << 16 else np.uint32), kind="stable")
    edges = np.searchsorted(bucket[order], np.arange(buckets + 1))
    for b in np.flatnonzero(np.diff(edges)).tolist():
        yield b, order[edges[b] : edges[b + 1]]


# Step 1: names of sampled suffixes. A chunk's equal names meet at once; their only further duty is to show the name to others.


def _send_samples(chunk: Chunk, cover: Cover, buckets: int) -> Iterator[tuple[int, bytes]]:
    at = chunk.samples(cover)
    name, _ = chunk.names(at, cover.span, both=False)
    order, twice = _repeated(name)
    several = np.zeros(len(at), bool)
    several[order] = twice
    shown = np.ones(len(at), bool)
    shown[order[1:]] = name[order][1:] != name[order][:-1]
    if several.any():
        yield -1, pack(_steps(at[several]))
    bucket, rest = (name % np.uint64(buckets)).astype(np.int64), (name // np.uint64(buckets)).astype(np.uint32)
    kept = np.flatnonzero(shown)
    for b, part in _deal(bucket[kept], buckets):
        part = kept[part]
        alone = part[~several[part]]
        yield b, pack(_steps(at[alone]), rest[alone], np.sort(rest[part[several[part]]]))


def _meet_samples(sent: list[list[np.ndarray]]) -> list[np.ndarray]:
    """Per sender, the positions whose name another sender has too."""
    keys = np.concatenate([k for _, own, seen in sent for k in (own, seen)])
    order, twice = _repeated(keys)
    repeated = np.empty(len(keys), bool)
    repeated[order] = twice
    out, begin = [], 0
    for steps, own, seen in sent:
        out.append(_unsteps(steps)[repeated[begin : begin + len(own)]])
        begin += len(own) + len(seen)
    return out


# Steps 2 and 3: of equal strings, all but the earliest.


def _send_strings(chunk: Chunk, at: np.ndarray, span: int, buckets: int) -> Iterator[tuple[int, bytes]]:
    high, low = chunk.names(at, span)
    later = _later(high, low, chunk.ids[chunk.doc[at]], chunk.place[at])
    if later.any():
        yield -1, pack(_steps(at[later]))
    kept = np.flatnonzero(~later)
    bucket = (high[kept] % np.uint64(buckets)).astype(np.int64)
    for b, part in _deal(bucket, buckets):
        part = kept[part]
        doc = chunk.doc[at[part]]
        first = np.flatnonzero(np.diff(doc, prepend=-1))
        counts = np.diff(np.append(first, len(doc))).astype(np.uint32)
        yield b, pack(_steps(at[part]), high[part] // np.uint64(buckets), low[part], chunk.ids[doc[first]], chunk.starts[doc[first]], counts)


def _meet_strings(sent: list[list[np.ndarray]]) -> list[np.ndarray]:
    """Per sender, the positions whose string starts earlier too."""
    at = [_unsteps(s[0]) for s in sent]
    ids = np.concatenate([np.repeat(s[3], s[5]) for s in sent])
    place = np.concatenate([a - np.repeat(s[4], s[5]) for a, s in zip(at, sent, strict=True)])
    high, low = np.concatenate([s[1] for s in sent]), np.concatenate([s[2] for s in sent])
    later = _later(high, low, ids, place)
    edges = np.cumsum([len(a) for a in at])[:-1]
    return [a[x] for a, x in zip(at, np.split(later, edges), strict=True)]


def _round(rows: DataFrame, make: Callable, meet: Callable, buckets: int) -> DataFrame:
    """One exchange: make(chunk, lists of positions) gives (bucket, packed entries), meet answers each sender.

    The result has (chunk, places): a packed array of positions for each chunk and bucket. What a chunk settles itself goes through a bucket of
    its own.
    """

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, blob, *found in zip(*[batch.column(i) for i in range(batch.num_columns)], strict=True):
                chunk = Chunk.read(blob.as_py())
                out = [(buckets + key.as_py() % buckets if b < 0 else b, x) for b, x in make(chunk, *[_places(f) for f in found])]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([b for b, _ in out], pa.int32()), pa.array([key.as_py()] * len(out), pa.int64()), pa.array([x for _, x in out], pa.binary())],
                    names=["bucket", "chunk", "blob"],
                )

    def answer(key: tuple, group: pa.Table) -> pa.Table:
        if key[0].as_py() >= buckets:
            return group.select(["chunk", "blob"]).rename_columns(["chunk", "places"])
        found = meet([unpack(b.as_py()) for b in group["blob"]])
        kept = [(c, f) for c, f in zip(group["chunk"].to_pylist(), found, strict=True) if len(f)]
        return pa.table({"chunk": pa.array([c for c, _ in kept], pa.int64()), "places": pa.array([pack(_steps(f)) for _, f in kept], pa.binary())})

    sent = rows.mapInArrow(send, "bucket int, chunk long, blob binary")
    return sent.groupBy("bucket").applyInArrow(answer, "chunk long, places binary")


def _places(blobs) -> np.ndarray:
    """Sorted positions of an Arrow list of packed arrays, or of null."""
    if not blobs.is_valid or not len(blobs.values):
        return np.zeros(0, np.int64)
    return np.sort(np.concatenate([_unsteps(*unpack(b.as_py())) for b in blobs.values]))


def _by_chunk(answers: DataFrame, name: str) -> DataFrame:
    """One row per chunk, its answers in a list: never more than the chunk has positions."""
    return answers.groupBy("chunk").agg(F.collect_list("places").alias(name))


def write_chunks(docs: DataFrame, *, chunk_bytes: int = 4 << 20) -> DataFrame:
    """The stored chunks (chunk, n_bytes, blob) of docs(doc_id, text): about chunk_bytes of text each, a longer document alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, ids, texts, size = TaskContext.get().partitionId() << 32, [], [], 0

        def row() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array([number], pa.int64()), pa.array([sum(map(len, texts))], pa.int64()), pa.array([Chunk.packed(ids, texts)], pa.binary())], names=["chunk", "n_bytes", "blob"]
            )

        for batch in batches:
            for doc_id, text in zip(batch.column(0), batch.column(1), strict=True):
                value = text.as_buffer().to_pybytes() if text.is_valid else b""
                if ids and size + len(value) > chunk_bytes:
                    yield row()
                    number, ids, texts, size = number + 1, [], [], 0
                ids.append(doc_id.as_py())
                texts.append(value)
                size += len(value) + 16
        if ids:
            yield row()

    return written(docs.mapInArrow(run, "chunk long, n_bytes long, blob binary"), "text-chunks")


def remove_repeated_strings(docs: DataFrame, *, length: int = 100, key: str = "doc_id", text: str = "text", chunk_bytes: int = 4 << 20) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept) for every row of docs; kept holds the remaining bytes.

    n_spans counts the maximal runs of removed bytes.
    """
    cover = Cover(length)
    chunks = write_chunks(docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")), chunk_bytes=chunk_bytes)
    total = chunks.agg(F.sum("n_bytes")).first()[0] or 0
    buckets = max(1, -(-total // BUCKET_BYTES))

    def triples(chunk: Chunk, hits: np.ndarray) -> Iterator[tuple[int, bytes]]:
        hit = np.zeros(chunk.n + 2 * cover.period, bool)
        hit[hits] = True
        whole = hit[hits + cover.period] & hit[hits + 2 * cover.period] & (chunk.left[hits] >= cover.triple)
        yield from _send_strings(chunk, hits[whole], cover.triple, buckets)

    def remaining(chunk: Chunk, hits: np.ndarray, earlier: np.ndarray) -> Iterator[tuple[int, bytes]]:
        at = np.flatnonzero(chunk.near(hits, cover) & ~chunk.settled(earlier, cover))
        yield from _send_strings(chunk, at, length, buckets)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for blob, earlier, later in zip(*[batch.column(i) for i in range(3)], strict=True):
                chunk = Chunk.read(blob.as_py())
                starts = chunk.settled(_places(earlier), cover)
                starts[_places(later)] = True
                begin = np.flatnonzero(starts)
                gone = chunk._covered(begin, begin + length)
                before = np.append(0, np.cumsum(gone))
                removed = before[chunk.ends] - before[chunk.starts]
                opens = np.diff(gone.astype(np.int8), prepend=0) > 0
                opens[chunk.starts[chunk.lengths > 0]] = gone[chunk.starts[chunk.lengths > 0]]
                opened = np.append(0, np.cumsum(opens))
                spans = opened[chunk.ends] - opened[chunk.starts]
                kept = np.frombuffer(chunk.data, np.uint8)[~gone].tobytes()
                edge = np.append(0, np.cumsum(chunk.lengths - removed))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(chunk.ids, pa.int64(), mask=~chunk.known),
                        pa.array(chunk.lengths, pa.int64()),
                        pa.array(removed, pa.int64()),
                        pa.array(spans, pa.int64()),
                        pa.array([kept[a:b] for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True)], pa.binary()),
                    ],
                    names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"],
                )

    sampled = _round(chunks.select("chunk", "blob"), lambda c: _send_samples(c, cover, buckets), _meet_samples, buckets)
    hits = written(_by_chunk(sampled, "hits"), "sampled-repeats")
    texts = chunks.select("chunk", "blob")
    near = texts.join(hits, "chunk", "left")
    earlier = written(_by_chunk(_round(near.select("chunk", "blob", "hits"), triples, _meet_strings, buckets), "earlier"), "settled-triples")
    merged = near.join(earlier, "chunk", "left")
    later = _by_chunk(_round(merged.select("chunk", "blob", "hits", "earlier"), remaining, _meet_strings, buckets), "later")
    judged = texts.join(earlier, "chunk", "left").join(later, "chunk", "left").select("blob", "earlier", "later")
    return judged.mapInArrow(cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")
