r"""SentencePiece encoding and decoding on a relational lattice.

1. Coding: documents are rewritten as numbers into the atom list of their chunk. A word is a space-led run (the space written as
   U+2581, also before the text), cut wherever no piece has the two characters side by side: no edge of the word's lattice crosses
   such a place, so the lattice falls into those of its atoms. A line feed is an atom of its own.
2. Lattice: every distinct atom of the corpus is exploded into its substrings up to the longest piece's length, and these are
   joined to the piece table. A character that no piece covers gives an edge of byte pieces.
3. Viterbi: edges are grouped by atom, and a higher-order fold over them, in order of their ends, keeps the best score of each
   end. The best path has the highest sum of piece scores; ties take the longest last piece, from the end backwards.
4. The ids of a chunk's atoms go back to the chunk, and its documents are spelled out.

One exchange carries both the atoms (to the buckets that own them) and the coded documents (to wait for the answers); the answers
are packed. The piece table is the model's, so its size bounds what is broadcast. Scores add up as in a unigram model; a model
made for merge order (BPE) is read by the same rule, so its ids can differ from that model's own merges, never in the text they
decode to. Pieces with an inner U+2581 (runs of spaces) are not used, as words end at spaces.

Null and empty texts have no ids. Documents keep their rows, repeated or not, and null ids. Texts decode exactly, but for U+2581
itself, which reads as a space. Extra columns are ignored. A recomputed task has to see its rows in the same order, as a scan does.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import count

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pipelake.llm.common import let
from pipelake.llm.packing import pack, unpack

SPACE = "▁"
BLOCK = 128
#: Ends of a long word that are exploded together.
SEGMENT = 64
#: A chunk's number is its input partition times 2^32 and its place there; a span is 2^10 partitions.
SPAN_BITS = 42
#: A lattice has many times the rows of its atoms, and a task sorts them by atom, so its share is made smaller than a usual one.
BUCKETS_A_PARTITION = 2


@dataclass(frozen=True)
class PieceModel:
    """Pieces by id, their scores, and the ids of the 256 byte pieces."""

    pieces: list[str]
    scores: list[float]
    usable: list[bool]
    bytes_at: list[int]

    @classmethod
    def read(cls, path: str) -> PieceModel:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = range(model.get_piece_size())
        pieces = [model.id_to_piece(i) for i in ids]
        special = [model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i) for i in ids]
        usable = [not s and SPACE not in p[1:] for s, p in zip(special, pieces, strict=True)]
        return cls(pieces, [model.get_score(i) for i in ids], usable, [model.piece_to_id(f"<0x{b:02X}>") for b in range(256)])

    @property
    def longest(self) -> int:
        return max(len(p) for p, ok in zip(self.pieces, self.usable, strict=True) if ok)

    @property
    def fallback(self) -> float:
        """Score of a character that no piece covers: below every piece."""
        return min(s for s, ok in zip(self.scores, self.usable, strict=True) if ok) - 10.0

    def neighbours(self) -> frozenset[str]:
        """Every two characters that some piece has side by side."""
        return frozenset(a + b for p, ok in zip(self.pieces, self.usable, strict=True) if ok for a, b in zip(p, p[1:], strict=False))

    def useful(self) -> dict[str, tuple[int, float]]:
        """(id, score) of the pieces that can be on a best path: none of them is beaten on its own text by shorter pieces."""
        known = {p: (i, float(s)) for i, (p, s, ok) in enumerate(zip(self.pieces, self.scores, self.usable, strict=True)) if ok}

        def by_parts(piece: str) -> float:
            best = [0.0]
            for end in range(1, len(piece) + 1):
                starts = range(1 if end == len(piece) else 0, end)
                best.append(max((best[s] + (known[piece[s:end]][1] if piece[s:end] in known else self.fallback) for s in starts if piece[s:end] in known or end - s == 1), default=float("-inf")))
            return best[-1]

        return {p: at for p, at in known.items() if len(p) == 1 or by_parts(p) <= at[1] + 1e-6}

    def table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(p, *at) for p, at in self.useful().items()], "piece string, id long, score double")

    def text_of(self) -> list[bytes]:
        """Text of every id; control pieces read as nothing."""
        out = [p.replace(SPACE, " ").encode() if ok or set(p) == {SPACE} else b"" for p, ok in zip(self.pieces, self.usable, strict=True)]
        for value, i in enumerate(self.bytes_at):
            out[i] = bytes([value])
        return out


def words_of(text: str) -> list[str]:
    """The words whose lattices make up a text's lattice, before they are cut."""
    return [w for part in text.split(" ") for w in re.findall(r"\n|[^\n]+", SPACE + part)] if text else []


def _ragged(offsets: np.ndarray, picks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in a flat array of the picked runs, one after another, and where each run ends among them."""
    counts = offsets[picks + 1] - offsets[picks]
    ends = np.cumsum(counts)
    return np.repeat(offsets[picks] - (ends - counts), counts) + np.arange(ends[-1] if len(ends) else 0), ends


class _Cutter:
    """Cuts words where no piece has the two characters side by side, many at once."""

    def __init__(self, neighbours: frozenset[str]):
        letters = sorted({c for pair in neighbours for c in pair})
        self.kind = np.zeros(ord(letters[-1]) + 2 if letters else 1, np.int32)
        self.kind[[ord(c) for c in letters]] = np.arange(1, len(letters) + 1)
        number = {c: i for i, c in enumerate(letters, 1)}
        self.joined = np.zeros((len(letters) + 1, len(letters) + 1), bool)
        for a, b in neighbours:
            self.joined[number[a], number[b]] = True

    def cut(self, parts: list[str]) -> tuple[list[str], np.ndarray]:
        """The atoms of all parts, each part led by U+2581, and the number of atoms before each part and after the last."""
        text = SPACE + SPACE.join(parts)
        points = np.frombuffer(text.encode("utf-32-le"), "<u4")
        kinds = self.kind[np.minimum(points, len(self.kind) - 1)]
        starts = np.cumsum([0, *[len(p) + 1 for p in parts]])
        opens = np.ones(len(text) + 1, bool)
        opens[1:-1] = ~self.joined[kinds[:-1], kinds[1:]]
        opens[starts] = True
        places = np.flatnonzero(opens)
        at = places.tolist()
        return [text[a:b] for a, b in zip(at, at[1:], strict=False)], np.searchsorted(places, starts)


class _Chunk:
    """Documents as numbers of their parts (what stands between spaces)."""

    def __init__(self):
        self.parts: dict[str, int] = defaultdict(count().__next__)
        self.keys: list[int | None] = []
        self.sizes: list[int] = []
        self.held: list[np.ndarray] = []
        self.size = 0

    def add(self, key: int | None, text: str) -> None:
        parts = text.split(" ") if text else []
        self.held.append(np.fromiter(map(self.parts.__getitem__, parts), np.int64, len(parts)))
        self.keys.append(key)
        self.sizes.append(len(parts))
        self.size += len(parts)

    def rows(self, cutter: _Cutter, route: int, buckets: list[int]) -> Iterator[tuple[int, bytes]]:
        """The atoms for each bucket, by frequency, and the coded documents: codes are ranks by frequency over the chunk."""
        names: dict[str, int] = defaultdict(count().__next__)
        atoms, part_ends = cutter.cut(list(self.parts)) if self.parts else ([], np.zeros(1, np.int64))
        of_part = np.fromiter(map(names.__getitem__, atoms), np.int64, len(atoms))
        at, ends = _ragged(part_ends, np.concatenate([np.zeros(0, np.int64), *self.held]))
        codes = of_part[at]
        ends = np.concatenate(([0], ends))[np.cumsum([0, *self.sizes])]
        order = np.argsort(-np.bincount(codes, minlength=len(names)), kind="stable")
        rank = np.empty(len(order), np.uint32)
        rank[order] = np.arange(len(order), dtype=np.uint32)
        by_rank = np.array(list(names), object)[order]
        owner = np.fromiter((xxhash.xxh3_64_intdigest(a) % len(buckets) for a in by_rank), np.uint32, len(by_rank))
        for b, places in _by_owner(owner):
            yield buckets[b], f"{route} {' '.join(by_rank[places].tolist())}".encode()
        keys = np.array([k or 0 for k in self.keys], np.int64)
        yield route, pack(np.array([k is None for k in self.keys], np.uint8), keys, np.diff(ends).astype("<u4"), rank[codes], owner)


def _by_owner(owner: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(bucket, ranks of its atoms, ascending)."""
    order = np.argsort(owner, kind="stable")
    found, first = np.unique(owner[order], return_index=True)
    return zip(found.tolist(), np.split(order, first[1:]), strict=True) if len(found) else iter(())


def bucket_count(spark: SparkSession) -> int:
    """Buckets of atoms, and tasks that make their lattices."""
    return BUCKETS_A_PARTITION * int(spark.conf.get("spark.sql.shuffle.partitions"))


def bucket_keys(spark: SparkSession) -> list[int]:
    """Negative numbers, one for each bucket, so that buckets are dealt out evenly."""
    n = bucket_count(spark)
    tried = spark.range(1, 24 * n + 1).select((-F.col("id")).alias("key"))
    return sorted((r.key for r in tried.groupBy(F.pmod(F.hash("key"), F.lit(n))).agg(F.max("key").alias("key")).collect()), reverse=True)


def coded(docs: DataFrame, model: PieceModel, *, key: str, text: str, chunk_words: int = 1 << 19) -> DataFrame:
    """(route, body): coded chunks by chunk number, and their atom lists by bucket key, below zero."""
    buckets, neighbours = bucket_keys(docs.sparkSession), model.neighbours()

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        route, chunk, cutter = TaskContext.get().partitionId() << 32, _Chunk(), _Cutter(neighbours)

        def full() -> pa.RecordBatch:
            rows = list(chunk.rows(cutter, route, buckets))
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary())], names=["route", "body"])

        for batch in batches:
            for doc_id, value in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                chunk.add(doc_id, value.as_py() or "")
                if chunk.size >= chunk_words:
                    yield full()
                    chunk, route = _Chunk(), route + 1
        if chunk.keys:
            yield full()

    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(code, "route long, body binary")


def lattice(words: DataFrame, model: PieceModel) -> DataFrame:
    """The edges (number, route, end, start, id, score, ..) of ``words(number, route, .., word)``; an id below zero stands for the
    bytes of a character, as a number, less one. Other columns ride on the edge of the first character alone.
    """
    pieces = F.broadcast(model.table(words.sparkSession))
    keys, reach = [c for c in words.columns if c != "word"], model.longest - 1
    n, shift = F.length("word"), lambda s: F.greatest(s * SEGMENT - reach, F.lit(0))
    cut = F.transform(
        F.sequence(F.lit(0), F.floor((n - 1) / SEGMENT)),
        lambda s: F.struct(shift(s).alias("shift"), (s * SEGMENT + 1).alias("least"), F.substr("word", shift(s) + 1, (s + 1) * SEGMENT - shift(s)).alias("part")),
    )
    whole = F.array(F.struct(F.lit(0).cast("long").alias("shift"), F.lit(1).cast("long").alias("least"), F.col("word").alias("part")))
    parts = words.select(*keys, F.inline(F.when(n <= SEGMENT, whole).otherwise(cut)))
    opened = parts.select(*keys, "shift", "part", F.explode(F.sequence((F.col("least") - F.col("shift")).cast("int"), F.length("part"))).alias("end"))
    starts = F.sequence(F.greatest(F.col("end") - model.longest, F.lit(0)), F.col("end") - 1)
    opened = opened.select(*keys, "shift", "part", "end", F.explode(starts).alias("start"))
    opened = opened.withColumn("piece", F.expr("substring(part, start + 1, end - start)"))
    joined = opened.join(pieces, "piece", "left").where("id IS NOT NULL OR end - start = 1")
    in_bytes = F.lit(-1) - F.conv(F.hex("piece"), 16, 10).cast("long")
    placed = lambda c: (F.col(c) + F.col("shift")).cast("int").alias(c)
    rest = [F.when(F.col("end") + F.col("shift") == 1, F.col(c)).alias(c) for c in keys if c not in ("number", "route")]
    return joined.select("number", "route", placed("end"), placed("start"), F.coalesce("id", in_bytes).alias("id"), F.coalesce("score", F.lit(model.fallback)).alias("score"), *rest)


def _push(blocks: Column, recent: Column, item: Column) -> tuple[Column, Column]:
    """Append an item to a list kept as full blocks and a short rest, so that each step copies little."""
    longer = F.array_append(recent, item)
    full = F.size(recent) >= BLOCK - 1
    return F.when(full, F.concat(blocks, F.array(longer))).otherwise(blocks), F.when(full, F.slice(recent, 1, 0)).otherwise(longer)


def _spelled(i: Column, byte_ids: Column) -> Column:
    """The ids of an id: those of its byte pieces, high byte first, if it is below zero."""
    value = F.lit(-1) - i
    units = F.filter(F.array(*[F.lit(1 << s).cast("long") for s in (24, 16, 8, 0)]), lambda u: (u == 1) | (value >= u))
    return F.when(i >= 0, F.array(i)).otherwise(F.transform(units, lambda u: F.get(byte_ids, F.pmod(F.floor(value / u), F.lit(256)).cast("int")).cast("long")))


def best_paths(words: DataFrame, model: PieceModel) -> DataFrame:
    """(route, .., ids) of ``words(number, route, .., word)``: the ids of the best path of each word."""
    rest = [c for c in words.columns if c not in ("number", "route", "word")]
    edges = lattice(words, model)
    carried = [F.first(c, ignorenulls=True).alias(c) for c in rest]
    grouped = edges.groupBy("number", "route").agg(F.sort_array(F.collect_list(F.struct("end", "start", "id", "score"))).alias("edges"), *carried)
    # The state has the best edge yet of the end at hand (the one-character edge comes last of an end and closes it), and the best
    # edge of each end before: recent ones, from position ``offset`` on, and full blocks of those that no piece reaches. It
    # passes through no ``let``, which would copy it.
    edge_type = "struct<end:int,start:int,id:bigint,score:double>"
    done_type = f"struct<total:double,e:{edge_type}>"
    none = F.lit(None).cast(edge_type)

    def state(pending: Column, best: Column, past: Column) -> Column:
        return F.struct(pending.alias("pending"), best.alias("best"), past.alias("past"))

    done = lambda total, e: F.struct(total.alias("total"), e.alias("e"))
    nothing = done(F.lit(float("-inf")), none)
    begin = state(nothing, F.array(done(F.lit(0.0), none)), F.struct(F.lit(0).alias("offset"), F.array().cast(f"array<array<{done_type}>>").alias("blocks")))

    def forward(s: Column, e: Column) -> Column:
        total = F.get(s["best"], e["start"] - s["past"]["offset"])["total"] + e["score"]
        better = total > s["pending"]["total"]
        longer = F.array_append(s["best"], F.when(better, done(total, e)).otherwise(s["pending"]))
        gone = F.size(s["best"]) + 1 - model.longest
        past = F.struct((s["past"]["offset"] + gone).alias("offset"), F.concat(s["past"]["blocks"], F.array(F.slice(longer, 1, gone))).alias("blocks"))
        closed = F.when(F.size(s["best"]) < BLOCK, state(nothing, longer, s["past"])).otherwise(state(nothing, F.slice(longer, -model.longest, model.longest), past))
        return F.when(e["end"] - e["start"] == 1, closed).when(better, state(done(total, e), s["best"], s["past"])).otherwise(s)

    def walked(s: Column) -> Column:
        def back(steps: Column) -> Column:
            last = F.size(steps) - 1
            path = F.struct(last.alias("at"), F.array().cast("array<array<bigint>>").alias("blocks"), F.array().cast("array<bigint>").alias("recent"))

            def take(p: Column, k: Column) -> Column:
                blocks, recent = _push(p["blocks"], p["recent"], F.get(steps, k)["e"]["id"])
                return F.when(k == p["at"], F.struct(F.get(steps, k)["e"]["start"].alias("at"), blocks.alias("blocks"), recent.alias("recent"))).otherwise(p)

            return F.aggregate(F.sequence(last, F.lit(1)), path, take, lambda p: F.reverse(F.concat(F.flatten(p["blocks"]), p["recent"])))

        return let(F.concat(F.flatten(s["past"]["blocks"]), s["best"]), back)

    ids = grouped.select("route", *rest, F.aggregate("edges", begin, forward, walked).alias("ids"))
    byte_ids = F.array(*map(F.lit, model.bytes_at))
    spelled = F.flatten(F.transform("ids", lambda i: _spelled(i, byte_ids)))
    return ids.withColumn("ids", F.when(F.exists("ids", lambda i: i < 0), spelled).otherwise(F.col("ids")))


def _answers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(bucket, places, ids) of words to packed (route, answer) of chunks: the places and ids of a bucket's atoms in the chunk."""
    held: list[pa.RecordBatch] = []
    size = 0

    def packed() -> pa.RecordBatch:
        rows = pa.Table.from_batches(held).combine_chunks()
        bucket, places, lists = (rows[c].chunk(0) for c in ("bucket", "places", "ids"))
        of = np.repeat(np.arange(len(places)), np.diff(places.offsets.to_numpy()))
        at = places.flatten()
        route, pos, bucket = at.field("chunk").to_numpy(), at.field("pos").to_numpy(), bucket.to_numpy()[of]
        order = np.lexsort((pos, bucket, route))
        picked, ends = _ragged(lists.offsets.to_numpy().astype(np.int64), of[order])
        flat, ends = lists.values.to_numpy()[picked].astype("<u4"), np.concatenate(([0], ends))
        route, bucket, pos, counts = route[order], bucket[order], pos[order], np.diff(ends).astype("<u4")
        first = np.flatnonzero(np.concatenate(([True], (np.diff(route) != 0) | (np.diff(bucket) != 0))))
        out = []
        for a, b in zip(first.tolist(), [*first[1:].tolist(), len(route)], strict=True):
            out.append(pack(bucket[a : a + 1], np.diff(pos[a:b], prepend=0).astype("<u4"), counts[a:b], flat[ends[a] : ends[b]]))
        return pa.RecordBatch.from_arrays([pa.array(route[first], pa.int64()), pa.array(out, pa.binary())], names=["route", "answer"])

    for batch in batches:
        held.append(batch)
        size += len(batch.column("places").flatten())
        if size >= 1 << 19:
            yield packed()
            held, size = [], 0
    if size:
        yield packed()


def encode(docs: DataFrame, model: PieceModel, *, key: str = "doc_id", text: str = "text", decoded: bool = False) -> DataFrame:
    """(doc_id, ids) of every row: ids as little-endian uint32 bytes. With ``decoded``, also the text that they decode to."""
    tasks = bucket_count(docs.sparkSession)
    # Both readers of the exchange ask for the same columns and rows, so it is made once. What follows is keyed by route too, and
    # moves nothing until the answers.
    dealt = coded(docs, model, key=key, text=text).where("route IS NOT NULL").repartition(tasks, "route")
    parts = dealt.select("route", F.when(F.col("route") < 0, F.split(F.col("body").cast("string"), " ")).alias("parts"))
    lists = parts.select("route", F.get("parts", F.lit(0)).cast("long").alias("chunk"), "parts")
    opened = lists.select("route", "chunk", F.posexplode_outer("parts").alias("pos", "word")).where("pos > 0")
    # A word's places are collected, and its lattice made, once for each span of chunks, so that the list stays bounded.
    span = F.shiftright("chunk", SPAN_BITS)
    words = opened.groupBy("word", "route", span.alias("span")).agg(F.collect_list(F.struct("chunk", (F.col("pos") - 1).alias("pos"))).alias("places"))
    paths = best_paths(words.select(F.monotonically_increasing_id().alias("number"), "route", "places", "word"), model)
    answers = paths.select(F.col("route").alias("bucket"), "places", "ids").mapInArrow(_answers, "route long, answer binary")
    answers = answers.repartition(tasks, "route").groupBy("route").agg(F.collect_list("answer").alias("answers"))
    number = {k: b for b, k in enumerate(bucket_keys(docs.sparkSession))}
    texts = docs.sparkSession.sparkContext.broadcast(model.text_of()) if decoded else None

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                if batch.column(0)[i].as_py() < 0:
                    continue
                absent, keys, sizes, codes, owner = unpack(batch.column(1)[i].as_py())
                keys = pa.array(keys, pa.int64(), mask=absent.astype(bool))
                ranks = dict(_by_owner(owner))
                flat, before = [np.zeros(0, "<u4")], 0
                counts, firsts = np.zeros(len(owner), np.int64), np.zeros(len(owner), np.int64)
                for answer in batch.column(2)[i].as_py() or ():
                    bucket, pos, lengths, ids = unpack(answer)
                    at = ranks[number[int(bucket[0])]][np.cumsum(pos, dtype=np.int64)]
                    counts[at], firsts[at] = lengths, before + np.cumsum(lengths, dtype=np.int64) - lengths
                    flat.append(ids)
                    before += len(ids)
                flat = np.concatenate(flat)
                ends = np.cumsum(sizes, dtype=np.int64)
                for a in range(0, len(keys), 64):
                    b = min(a + 64, len(keys))
                    first = ends[a] - sizes[a]
                    word = codes[first : ends[b - 1]]
                    n = counts[word]
                    total = np.concatenate(([0], np.cumsum(n)))
                    tokens = flat[np.repeat(firsts[word] - total[:-1], n) + np.arange(total[-1])]
                    cuts = total[np.concatenate(([first], ends[a:b])) - first]
                    out = [tokens[x:y].tobytes() for x, y in zip(cuts[:-1], cuts[1:], strict=True)]
                    columns = {"doc_id": keys.slice(a, b - a), "ids": pa.array(out, pa.binary())}
                    if decoded:
                        columns["text"] = pa.array([_text(ids, texts.value) for ids in out], pa.string())
                    yield pa.RecordBatch.from_pydict(columns)

    schema = "doc_id long, ids binary" + ", text string" * decoded
    own = F.when(F.col("route") >= 0, F.col("body")).alias("body")
    return dealt.join(answers, "route", "left").select("route", own, "answers").mapInArrow(spell, schema)


def _text(ids: bytes | None, table: list[bytes]) -> str:
    return b"".join(map(table.__getitem__, np.frombuffer(ids or b"", "<u4").tolist())).decode(errors="replace")[1:]


def decode(encoded: DataFrame, model: PieceModel) -> DataFrame:
    """(doc_id, ids, text) of (doc_id, ids); the text of no ids is empty. The piece table is broadcast."""
    texts = encoded.sparkSession.sparkContext.broadcast(model.text_of())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = texts.value
        for batch in batches:
            out = [_text(ids, table) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.string())], names=["doc_id", "ids", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, ids binary, text string")
