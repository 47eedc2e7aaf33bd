r"""Greedy word-piece token counts by a linear longest-match automaton.

A word is split by always taking the longest vocabulary piece. The automaton is a trie of the
pieces; each node has a failure link (where to go on when no longer piece fits) and the number of
pieces that are popped on the way. Counting reads each byte of a word once and never builds a piece.

Words are ``[^\x20\x09-\x0D]+`` with A-Z lower-cased, read as UTF-8 bytes and closed by an end mark.
A word that the vocabulary cannot cover counts as one unknown token. Null, empty and blank
texts have no words and no tokens. Rows are independent; extra columns are left alone.
"""

from __future__ import annotations

import itertools
import json
from collections import deque
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

END = 256
_STEP = 512


@dataclass(frozen=True)
class Automaton:
    """``child[node * 512 + byte]``, ``fail[node]`` (-1: none) and ``popped[node]``; node 0 is the root."""

    child: dict[int, int]
    fail: list[int]
    popped: list[int]

    def count(self, word: bytes) -> int:
        """Number of greedy pieces of a word; 1 if it cannot be covered."""
        child, fail, popped = self.child, self.fail, self.popped
        node = pieces = 0
        for symbol in (*word, END):
            while (following := child.get(node * _STEP + symbol)) is None:
                pieces += popped[node]
                node = fail[node]
                if node < 0:
                    return 1
            node = following
        return pieces + 1


def build_automaton(pieces: Iterable[tuple[int, ...]]) -> Automaton:
    """Automaton of pieces given as byte values, END last in those that close a word."""
    child: dict[int, int] = {}
    accepts = [False]
    for piece in pieces:
        node = 0
        for symbol in piece:
            key = node * _STEP + symbol
            if key not in child:
                child[key] = len(accepts)
                accepts.append(False)
            node = child[key]
        accepts[node] = node != 0
    below: list[list[tuple[int, int]]] = [[] for _ in accepts]
    for key, node in child.items():
        below[key // _STEP].append((key % _STEP, node))
    fail, popped = [-1] * len(accepts), [0] * len(accepts)
    waiting = deque([0])
    while waiting:
        parent = waiting.popleft()
        for symbol, node in below[parent]:
            waiting.append(node)
            if accepts[node]:
                fail[node], popped[node] = 0, 1
                continue
            at, count = fail[parent], popped[parent]
            while at >= 0 and at * _STEP + symbol not in child:
                count += popped[at]
                at = fail[at]
            if at >= 0:
                fail[node], popped[node] = child[at * _STEP + symbol], count
    return Automaton(child, fail, popped)


def byte_alphabet() -> dict[str, int]:
    """The printable stand-ins that byte-level vocabularies use for byte values."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    table = {chr(b): b for b in plain}
    table |= {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in plain)}
    return table


def read_pieces(path: str, end_mark: str = "</w>") -> list[tuple[int, ...]]:
    """Pieces of a byte-level vocabulary file whose word-closing pieces end with ``end_mark``."""
    with open(path, encoding="utf-8") as file:
        vocabulary = json.load(file)["model"]["vocab"]
    alphabet = byte_alphabet()
    pieces = []
    for piece in vocabulary:
        closes = piece.endswith(end_mark)
        body = piece.removesuffix(end_mark)
        if all(c in alphabet for c in body):
            pieces.append((*(alphabet[c] for c in body), *((END,) if closes else ())))
    return pieces


class _Counts(dict):
    """Counts by word, emptied when ``bound`` words are held."""

    def __init__(self, automaton: Automaton, bound: int):
        super().__init__()
        self.automaton, self.bound = automaton, bound

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.bound:
            self.clear()
        count = self.automaton.count(word)
        if len(word) <= 64:
            self[word] = count
        return count


def token_counts(spark: SparkSession, automaton: Automaton, text: Column, *, cache_words: int = 300_000) -> Column:
    """Struct (n_words, n_tokens) of a text. The automaton is broadcast; the vocabulary file bounds its size."""
    shared = spark.sparkContext.broadcast(automaton)

    @F.pandas_udf("n_words long, n_tokens long")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        counts = _Counts(shared.value, cache_words)
        for batch in batches:
            n_words, n_tokens = [], []
            for value in batch:
                words = value.encode().lower().split() if value else ()
                n_words.append(len(words))
                n_tokens.append(sum(map(counts.__getitem__, words)))
            yield pd.DataFrame({"n_words": n_words, "n_tokens": n_tokens})

    return count(text)


def count_tokens(docs: DataFrame, vocabulary: str, *, text: str = "text") -> DataFrame:
    """docs with n_words and n_tokens, which replace columns of those names."""
    name = next(n for n in map("_counts{}".format, itertools.count()) if n not in docs.columns)
    counted = docs.withColumn(name, token_counts(docs.sparkSession, build_automaton(read_pieces(vocabulary)), F.col(text)))
    return counted.withColumns({"n_words": F.col(f"{name}.n_words"), "n_tokens": F.col(f"{name}.n_tokens")}).drop(name)
