r"""Ranked lexical search by hashed max-sketches.

*Index.* A document's sketch has 2^b coordinates, sixteen or more per distinct term. Each term goes to the coordinate its hash names, and a coordinate keeps the
maximum over its terms. A term's impact grows with its number of occurrences only (the rest of it is the same for all terms of a
document), so the maximum of the occurrences is kept, and impacts are looked up from it when the totals of the corpus are known. The stored index
holds chunks of documents: sketches, lengths, the documents' terms in order (compressed one by one), and the chunk's document frequencies.

*Search.* The query set is cut into blocks of items. A task reads its chunks; one matrix product of the looked-up impacts with the block's weights gives an upper bound
for each document and item: a coordinate is at least as large as each term in it. Documents are then scored exactly in descending order of their bounds, item
by item, until no bound reaches the item's k-th best score. The best k of each item go on to the k best of all tasks.

A term is a maximal match of ``[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+``, with A-Z lower-cased. With N documents that have terms, L terms in them, n in
the document at hand, tf of them the term at hand, which df documents hold: the weight is w = floor(1000 ln((2N + 2) / (2 df + 1))), the
length m = 25 + (75 n N) div L, the impact (10^9 tf) div (1000 tf + 8 m), and the score the sum of w times impact over the item's terms, repeats included.

Null, empty and blank texts have no terms: such documents are not in the index, such items have no result. Items with equal ids are
one item with all their terms. Each row of docs is a document, repeated or not; equal scores go by ascending id, null first. An empty
table gives an empty result. Sketches end at 2^16 coordinates: texts of more distinct terms have looser bounds and right scores.
"""

from __future__ import annotations

import math
from bisect import insort
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pipelake.llm.common import ascii_lower, written
from pipelake.llm.hashing import WordHashes
from pipelake.llm.packing import pack, unpack

TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Bytes that are part of no term become blanks; A-Z become a-z.
_TERM_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))
SHARE, LEAST_BITS, MOST_BITS, TOP_COUNT = 16, 6, 16, 255
#: An impact is below 10^9 / 1000.
LIMIT = 1e6
#: Bounds are computed in single precision; this covers its rounding.
SLACK = 1.0001


def build_index(docs: DataFrame, *, key: str = "doc_id", text: str = "text", chunk_bytes: int = 4 << 20, chunk_docs: int = 1 << 13) -> DataFrame:
    """The stored index (n_docs, n_terms, head, texts, terms, frequencies), one row per chunk of documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, gathered, frequency, size = WordHashes(), [], Counter(), 0

        def row() -> pa.RecordBatch:
            gathered.sort(key=lambda d: len(d[2]))  # equal widths together
            ids, counts, sketches, texts = zip(*gathered, strict=True)
            head = pack(
                np.array([i or 0 for i in ids], np.int64),
                np.array([i is not None for i in ids], np.uint8),
                np.array(counts, np.uint32),
                np.array([len(s).bit_length() - 1 for s in sketches], np.uint8),
                np.concatenate(sketches),
            )
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([len(ids)], pa.int64()),
                    pa.array([sum(counts)], pa.int64()),
                    pa.array([head], pa.binary()),
                    pa.array([texts], pa.list_(pa.binary())),
                    pa.array([list(frequency)], pa.list_(pa.binary())),
                    pa.array([list(frequency.values())], pa.list_(pa.int32())),
                ],
                names=["n_docs", "n_terms", "head", "texts", "terms", "frequencies"],
            )

        for batch in batches:
            for doc_id, value in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                body = value.as_buffer().to_pybytes().translate(_TERM_BYTES) if value.is_valid else b""
                words = body.split()
                if not words:
                    continue
                if gathered and (size + len(body) > chunk_bytes or len(gathered) >= chunk_docs):
                    yield row()
                    gathered, frequency, size = [], Counter(), 0
                counts = Counter(words)
                frequency.update(counts.keys())
                bits = min(MOST_BITS, max(LEAST_BITS, (SHARE * len(counts) - 1).bit_length()))
                sketch = np.zeros(1 << bits, np.uint8)
                at = (hashes.of(list(counts)) & np.uint64((1 << bits) - 1)).astype(np.int64)
                np.maximum.at(sketch, at, np.minimum(np.fromiter(counts.values(), np.int64, len(counts)), TOP_COUNT).astype(np.uint8))
                gathered.append((doc_id, len(words), sketch, zstandard.compress(b" ".join(words), 1)))
                size += len(body)
        if gathered:
            yield row()

    schema = "n_docs long, n_terms long, head binary, texts array<binary>, terms array<binary>, frequencies array<int>"
    return written(docs.select(F.col(key).cast("long"), F.col(text)).mapInArrow(run, schema), "sketch-index")


class _Block:
    """A block of items: their terms and weights, and the search of index chunks for them."""

    def __init__(self, table: pa.Table, n_docs: int, n_terms: int, k: int):
        self.n_docs, self.n_terms, self.k = n_docs, n_terms, k
        first: dict = {}
        number = np.array([first.setdefault(i, len(first)) for i in table["item_id"].to_pylist()], np.int64)
        self.items = table["item_id"].combine_chunks().take(pa.array(np.unique(number, return_index=True)[1]))
        weights = [c * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1))) for c, df in zip(table["n"].to_pylist(), table["df"].to_pylist(), strict=True)]
        self.terms: dict[bytes, int] = {}
        row = np.array([self.terms.setdefault(t.encode(), len(self.terms)) for t in table["term"].to_pylist()], np.int64)
        self.exact = np.zeros((len(self.terms), len(first)), np.int64)
        np.add.at(self.exact, (row, number), np.array(weights, np.int64))
        self.hashes = WordHashes().of(list(self.terms))
        self.folded: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def fold(self, bits: int) -> tuple[np.ndarray, np.ndarray]:
        """Coordinates that the terms go to in sketches of 2^bits, and the weights of each by item."""
        if bits not in self.folded:
            at, number = np.unique(self.hashes & np.uint64((1 << bits) - 1), return_inverse=True)
            weights = np.zeros((len(at), len(self.items)), np.float64)
            np.add.at(weights, number, self.exact)
            self.folded[bits] = at.astype(np.int64), weights.astype(np.float32)
        return self.folded[bits]

    def bounds(self, bits: np.ndarray, lengths: np.ndarray, sketches: np.ndarray) -> np.ndarray:
        """Upper bounds of the scores, documents by items."""
        out = np.empty((len(bits), len(self.items)), np.float32)
        ends = np.cumsum(np.int64(1) << bits.astype(np.int64))
        for b in np.unique(bits).tolist():
            these = np.flatnonzero(bits == b)
            at, weights = self.fold(b)
            rows = sketches[ends[these[0]] - (1 << b) : ends[these[-1]]].reshape(len(these), 1 << b)
            step = max(1, (1 << 21) // max(1, len(at)))
            for a in range(0, len(these), step):
                count = rows[a : a + step][:, at].astype(np.float32)
                impact = 1e9 * count / np.maximum(1000 * count + 8 * lengths[these[a : a + step], None].astype(np.float32), 1)
                impact[count == TOP_COUNT] = LIMIT
                out[these[a : a + step]] = impact @ weights
        return out * np.float32(SLACK) + np.float32(1)

    def score(self, text: bytes, length: int) -> np.ndarray:
        """Exact scores of one document, by item."""
        counts = Counter(t for t in map(self.terms.get, zstandard.decompress(text).split()) if t is not None)
        if not counts:
            return np.zeros(len(self.items), np.int64)
        impact = np.array([1_000_000_000 * c // (1000 * c + 8 * length) for c in counts.values()], np.int64)
        return impact @ self.exact[list(counts)]

    def search(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: list[list[tuple[int, bool, int]]] = [[] for _ in range(len(self.items))]
        limit = np.ones(len(self.items))
        columns = np.arange(len(self.items))
        for batch in batches:
            for head, texts in zip(batch.column(0), batch.column(1), strict=True):
                ids, known, counts, bits, sketches = unpack(head.as_py())
                lengths = np.array([25 + 75 * n * self.n_docs // self.n_terms for n in counts.tolist()], np.int64)
                bounds = self.bounds(bits, lengths, sketches)
                while True:
                    top = bounds.argmax(0)
                    reach = bounds[top, columns] >= limit
                    reach &= bounds[top, columns] > 1
                    if not reach.any():
                        break
                    for d in np.unique(top[reach]).tolist():
                        bounds[d] = 0
                        scores = self.score(texts.values[d].as_py(), int(lengths[d]))
                        for i in np.flatnonzero(scores >= limit).tolist():
                            insort(best[i], (-int(scores[i]), bool(known[d]), int(ids[d])))
                            del best[i][self.k :]
                            if len(best[i]) == self.k:
                                limit[i] = -best[i][-1][0]
        rows = [(i, *entry) for i, entries in enumerate(best) for entry in entries]
        yield pa.RecordBatch.from_arrays(
            [
                self.items.take(pa.array([r[0] for r in rows], pa.int64())),
                pa.array([r[3] if r[2] else None for r in rows], pa.int64()),
                pa.array([-r[1] for r in rows], pa.int64()),
            ],
            names=["item_id", "doc_id", "score"],
        )


def search(index: DataFrame, items: DataFrame, *, k: int = 10, item_id: str = "item_id", text: str = "text", block_terms: int = 1 << 14, block_items: int = 1 << 8) -> DataFrame:
    """(item_id, rank, doc_id, score): the k best documents with a score above 0 of each item, ranks from 1."""
    kind = items.select(item_id).schema[0].dataType.simpleString()
    wanted = items.select(F.col(item_id).alias("item_id"), F.explode(F.regexp_extract_all(ascii_lower(F.col(text)), F.lit(TERM), F.lit(0))).alias("term"))
    wanted = wanted.groupBy("item_id", "term").agg(F.count("*").alias("n"))
    held = index.select(F.explode(F.arrays_zip("terms", "frequencies")).alias("t")).select(F.col("t.terms").cast("string").alias("term"), F.col("t.frequencies").alias("df"))
    held = held.join(wanted.select("term").distinct(), "term", "left_semi").groupBy("term").agg(F.sum("df").alias("df"))
    weighed = written(wanted.join(held, "term"), "item-terms")
    n_docs, n_terms = index.agg(F.coalesce(F.sum("n_docs"), F.lit(0)), F.coalesce(F.sum("n_terms"), F.lit(0))).first()
    n_items, n_entries = weighed.agg(F.count_distinct(F.coalesce(F.col("item_id").cast("string"), F.lit(""))), F.count("*")).first()
    blocks = max(1, -(-n_entries // block_terms), -(-n_items // block_items))
    found = None
    for b in range(blocks):
        part = weighed.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b).toArrow()
        if not part.num_rows:
            continue
        block = _Block(part, n_docs, n_terms, k)
        best = index.select("head", "texts").mapInArrow(block.search, f"item_id {kind}, doc_id long, score long")
        found = best if found is None else found.union(best)
    if found is None:
        found = items.sparkSession.createDataFrame([], f"item_id {kind}, doc_id long, score long")
    order = Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_first("doc_id"))
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("item_id", "rank", "doc_id", "score")
