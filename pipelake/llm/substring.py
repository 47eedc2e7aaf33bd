r"""Exact substring deduplication by fixed-block anchors.

A window of w words that two documents share contains a whole block of each document's grid of
non-overlapping blocks of b = (w + 1) / 2 words. So: index the blocks, probe them with every rolling window of
b words, and each true repeat gives a hit. Hits are extended: only the w-word windows around hits are compared in
full, and a window is removed when its words also start in a document with a smaller id. Overlapping
windows add up to maximal repeats.

What moves is packed. A task gathers the windows of many documents, spreads them over buckets by hash, and sends one
compressed array per bucket, and answers go back packed by parts of the documents. Within a task equal windows meet at once: the task settles them and sends one
of them on, so a passage that every document repeats costs a bucket one entry per task.

Words are ``[^\x20\x09-\x0D]+``, unchanged. Null and blank texts have no words. Rows with a null id are neither
references nor changed. Rows with equal ids never remove each other's words: their different texts count as one document with
gaps, each at an offset (``base``) of its own; together they may have up to 2^31 characters. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pipelake.llm.common import written
from pipelake.llm.hashing import WordHashes, mixed, window_hashes
from pipelake.llm.packing import pack, unpack

QUIET, ANCHOR = 1, 2


def _places(doc: np.ndarray, place: np.ndarray) -> list[np.ndarray]:
    """Entries sorted by (doc, place) as document ids, entries of each, and steps of the place."""
    first = np.flatnonzero(np.diff(doc, prepend=doc[:1] - 1)) if len(doc) else np.zeros(0, np.int64)
    step = np.diff(place, prepend=0).astype(np.int32)
    step[first] = place[first]
    return [doc[first], np.diff(np.append(first, len(doc))).astype(np.int32), step]


def _unplaces(docs: np.ndarray, counts: np.ndarray, step: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    total = np.cumsum(step, dtype=np.int64)
    starts = np.cumsum(counts, dtype=np.int64) - counts
    before = np.where(starts > 0, total[starts - 1], 0) if len(total) else starts
    return np.repeat(docs, counts), (total - np.repeat(before, counts)).astype(np.int32)


def _by_document(doc: np.ndarray, place: np.ndarray) -> pa.Table:
    order = np.lexsort((place, doc))
    doc, place = doc[order], place[order]
    new = np.flatnonzero(np.diff(doc, prepend=doc[:1] - 1)) if len(doc) else np.zeros(0, np.int64)
    offsets = np.append(new, len(doc)).astype(np.int32)
    places = pa.ListArray.from_arrays(pa.array(offsets), pa.array(place, pa.int32()))
    return pa.table({"doc_id": pa.array(doc[new], pa.int64()), "places": places})


def _groups(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order that sorts by the keys, start of each group in it, group number of each sorted entry."""
    order = np.lexsort(keys[::-1]) if len(keys) > 1 else np.argsort(keys[0], kind="stable")
    new = np.zeros(len(order), bool)
    new[:1] = True
    for key in keys:
        sorted_key = key[order]
        new[1:] |= sorted_key[1:] != sorted_key[:-1]
    return order, np.flatnonzero(new), np.cumsum(new) - 1


class _Chunk:
    """Words of many documents, gathered until they are worth packing."""

    def __init__(self):
        self.hashes: list[np.ndarray] = []
        self.ids: list[int] = []
        self.bases: list[int] = []
        self.hits: list[np.ndarray] = []
        self.size = 0

    def add(self, doc_id: int, base: int, hashes: np.ndarray, hits: np.ndarray | None = None) -> None:
        self.ids.append(doc_id)
        self.bases.append(base)
        self.hashes.append(hashes)
        self.hits.append(hits)
        self.size += len(hashes)

    def windows(self, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """All word hashes; then, for each window inside a document, its place in them, its document and its place there."""
        lengths = np.array([len(h) for h in self.hashes], np.int64)
        words = np.concatenate(self.hashes)
        starts = np.cumsum(lengths) - lengths
        counts = np.maximum(lengths - size + 1, 0)
        place = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
        in_document = place + np.repeat(np.array(self.bases, np.int64), counts)
        return words, np.repeat(starts, counts) + place, np.repeat(np.array(self.ids, np.int64), counts), in_document.astype(np.int32)


def _spread(bucket: np.ndarray, buckets: int, columns: list[np.ndarray], doc: np.ndarray, place: np.ndarray) -> Iterator[tuple[int, bytes]]:
    """One packed string per bucket, entries by (doc, place)."""
    order = np.lexsort((place, doc, bucket))
    edges = np.searchsorted(bucket[order], np.arange(buckets + 1))
    for b in range(buckets):
        part = order[edges[b] : edges[b + 1]]
        if len(part):
            yield b, pack(*_places(doc[part], place[part]), *[c[part] for c in columns])


def _settled(doc: np.ndarray, place: np.ndarray, buckets: int) -> Iterator[tuple[int, bytes]]:
    """Entries that the task has settled itself, as a bucket of its own."""
    if len(doc):
        order = np.lexsort((place, doc))
        yield buckets + int(doc[order[0]] % buckets), pack(*_places(doc[order], place[order]))


def _probes(chunk: _Chunk, block: int, buckets: int) -> Iterator[tuple[int, bytes]]:
    """Rolling windows of ``block`` words; those on the grid are the reference blocks."""
    words, at, doc, place = chunk.windows(block)
    value = window_hashes(words, block)[at]
    order, starts, number = _groups(value)
    doc, place, value = doc[order], place[order], value[order]
    several = np.minimum.reduceat(doc, starts) < np.maximum.reduceat(doc, starts)
    anchor = np.logical_or.reduceat(place % block == 0, starts)
    met = (several & anchor)[number]
    yield from _settled(doc[met], place[met], buckets)
    first = np.zeros(len(doc), bool)
    first[starts] = True
    go = ~met | first
    flags = (met * (QUIET | ANCHOR) | (place % block == 0) * ANCHOR).astype(np.uint8)[go]
    value = value[go]
    yield from _spread((value % np.uint64(buckets)).astype(np.int64), buckets, [(value // np.uint64(buckets)).astype(np.uint32), flags], doc[go], place[go])


def _meet_probes(blobs: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(doc, place) of the windows that equal a reference block of another document or are such a block."""
    parts = [unpack(b) for b in blobs]
    doc, place = (np.concatenate(x) for x in zip(*(_unplaces(*p[:3]) for p in parts), strict=True))
    order, starts, number = _groups(np.concatenate([p[3] for p in parts]))
    doc, place, flags = doc[order], place[order], np.concatenate([p[4] for p in parts])[order]
    several = (np.minimum.reduceat(doc, starts) < np.maximum.reduceat(doc, starts)) | np.logical_or.reduceat(flags & QUIET > 0, starts)
    hit = (several & np.logical_or.reduceat(flags & ANCHOR > 0, starts))[number] & (flags & QUIET == 0)
    return doc[hit], place[hit]


def _full_windows(chunk: _Chunk, window: int, block: int, buckets: int) -> Iterator[tuple[int, bytes]]:
    """The windows of ``window`` words that hold a hit."""
    words, at, doc, place = chunk.windows(window)
    near = np.zeros(len(words) + 1, np.int64)
    offset = 0
    for hashes, hits in zip(chunk.hashes, chunk.hits, strict=True):
        np.add.at(near, offset + np.maximum(hits - (window - block), 0), 1)
        np.add.at(near, offset + hits + 1, -1)
        offset += len(hashes)
    keep = np.cumsum(near)[at] > 0
    at, doc, place = at[keep], doc[keep], place[keep]
    if not len(at):
        return
    high, low = window_hashes(words, window, 1)[at], window_hashes(words, window, 2)[at].astype(np.uint32)
    order, starts, number = _groups(high, low)
    doc, place, high, low = doc[order], place[order], high[order], low[order]
    later = doc > np.minimum.reduceat(doc, starts)[number]
    yield from _settled(doc[later], place[later], buckets)
    go = ~later
    yield from _spread((high[go] % np.uint64(buckets)).astype(np.int64), buckets, [high[go] // np.uint64(buckets), low[go]], doc[go], place[go])


def _meet_full(blobs: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(doc, place) of the windows that start in a smaller document too."""
    parts = [unpack(b) for b in blobs]
    doc, place = (np.concatenate(x) for x in zip(*(_unplaces(*p[:3]) for p in parts), strict=True))
    order, starts, number = _groups(np.concatenate([p[3] for p in parts]), np.concatenate([p[4] for p in parts]))
    doc, place = doc[order], place[order]
    later = doc > np.minimum.reduceat(doc, starts)[number]
    return doc[later], place[later]


def _own(places: pa.ListScalar, base: int, words: int) -> np.ndarray:
    """The places of a document that lie in one of its rows, counted from the row's first word."""
    own = places.values.to_numpy(zero_copy_only=False).astype(np.int64) - base
    return own[(own >= 0) & (own < words)]


def _columns(batch: pa.RecordBatch) -> tuple[pa.Array, pa.Array, list[int], pa.Array | None]:
    """The ids, texts, bases and places of a batch; base is absent where no id repeats, and places where none are known yet."""
    optional = lambda name: batch.column(i) if (i := batch.schema.get_field_index(name)) >= 0 else None
    bases = optional("base")
    return batch.column(0), batch.column(1), [0] * batch.num_rows if bases is None else bases.to_pylist(), optional("places")


def _chunks(batches: Iterator[pa.RecordBatch], least_words: int, chunk_words: int) -> Iterator[_Chunk]:
    """Documents of (doc_id, text[, base][, places]) rows that have an id and least_words words or more, in chunks."""
    hashes, chunk = WordHashes(), _Chunk()
    for batch in batches:
        ids, texts, bases, places = _columns(batch)
        for i, doc_id in enumerate(ids.to_pylist()):
            if places is not None and not places[i].is_valid:
                continue
            words = (texts[i].as_py() or "").encode().split()
            if len(words) < least_words or doc_id is None:
                continue
            hits = None if places is None else _own(places[i], bases[i], len(words))
            chunk.add(doc_id, bases[i], hashes.of(words), hits)
            if chunk.size >= chunk_words:
                yield chunk
                chunk = _Chunk()
    if chunk.ids:
        yield chunk


def repeated_windows(docs: DataFrame, *, window: int = 13, chunk_words: int = 1 << 19) -> DataFrame:
    """(doc_id, places): starts of the windows of docs(doc_id, text[, base]) that a smaller document has too."""
    block = (window + 1) // 2
    buckets = 2 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    parts = max(1, buckets // 4)

    def packed(make, least: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for chunk in _chunks(batches, least, chunk_words):
                rows = list(make(chunk))
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], names=["bucket", "blob"])

        return run

    def met(meet):
        def run(key: tuple, rows: pa.Table) -> pa.Table:
            blobs = rows["blob"].to_pylist()
            if key[0].as_py() >= buckets:
                found = [_unplaces(*unpack(b)) for b in blobs]
                doc, place = np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])
            else:
                doc, place = meet(blobs)
            sent = list(_spread((mixed(doc.view(np.uint64)) % np.uint64(parts)).astype(np.int64), parts, [], doc, place))
            return pa.table({"part": pa.array([r[0] for r in sent], pa.int32()), "blob": pa.array([r[1] for r in sent], pa.binary())})

        return run

    def by_document(rows: pa.Table) -> pa.Table:
        found = [_unplaces(*unpack(b)) for b in rows["blob"].to_pylist()]
        return _by_document(np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found]))

    def gathered(rows: DataFrame, make, least: int, meet) -> DataFrame:
        sent = rows.mapInArrow(packed(make, least), "bucket int, blob binary")
        found = sent.groupBy("bucket").applyInArrow(met(meet), "part int, blob binary")
        return found.groupBy("part").applyInArrow(by_document, "doc_id long, places array<int>")

    hits = gathered(docs, lambda c: _probes(c, block, buckets), window, _meet_probes)
    # An inner join would filter the texts below their exchange, which the other readers could then not share.
    near = docs.join(hits, "doc_id", "left").select(*docs.columns, "places")
    return gathered(near, lambda c: _full_windows(c, window, block, buckets), window, _meet_full)


def _without(words: list[bytes], places: np.ndarray, window: int) -> list[bytes]:
    gone = np.zeros(len(words) + 1, np.int64)
    np.add.at(gone, places, 1)
    np.add.at(gone, places + window, -1)
    return [w for w, g in zip(words, np.cumsum(gone)[:-1].tolist(), strict=True) if not g]


def _based(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text), with base where ids repeat: the characters of the id's other texts that come before (in the order of their hashes), else 0.

    Without repeated ids there is no such column: a constant one would be cut from some readers' exchange of the texts, and they would not share it.
    """
    shared = written(docs.where("doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1").select("doc_id"), "repeated-ids")
    if shared.isEmpty():
        return docs
    kind = F.md5(F.coalesce("text", F.lit(""))).alias("kind")
    texts = docs.join(shared, "doc_id", "left_semi").select("doc_id", kind, (F.length(F.coalesce("text", F.lit(""))) + 1).alias("n")).distinct()
    before = F.sum("n").over(Window.partitionBy("doc_id").orderBy("kind").rowsBetween(Window.unboundedPreceding, -1))
    bases = texts.select("doc_id", "kind", F.coalesce(before, F.lit(0)).cast("int").alias("base"))
    return docs.withColumn("kind", kind).join(bases, ["doc_id", "kind"], "left").select("doc_id", "text", F.coalesce("base", F.lit(0)).alias("base"))


def remove_repeats(docs: DataFrame, *, window: int = 13, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_words, n_removed, kept_text) for every row; kept words are joined by one space.

    The texts are dealt out by id once; the probes, the full windows and the cut all read that one exchange.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, removed, texts = [], [], []
            for value, base, places in zip(*_columns(batch)[1:], strict=True):
                words = (value.as_py() or "").encode().split()
                kept = _without(words, _own(places, base, len(words)), window) if places.is_valid else words
                counts.append(len(words))
                removed.append(len(words) - len(kept))
                texts.append(b" ".join(kept).decode())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(counts, pa.int64()), pa.array(removed, pa.int64()), pa.array(texts, pa.string())],
                names=["doc_id", "n_words", "n_removed", "kept_text"],
            )

    rows = _based(docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))).repartition("doc_id")
    repeats = repeated_windows(rows, window=window)
    joined = rows.join(repeats, "doc_id", "left").select(*rows.columns, "places")
    return joined.mapInArrow(cut, "doc_id long, n_words long, n_removed long, kept_text string")
