r"""Language identification in two steps: family first, then one-versus-one linear SVMs inside it.

A text is its hashed counts of byte 2-, 3- and 4-grams (ASCII letters lower-cased, other ASCII a
space). Linear SVMs, one per family against the rest, pick the family; inside it an SVM for every pair of
languages votes, and summed margins break ties. The model is fitted here, on a bounded sample of labelled rows:
about ``train_docs`` per language, chosen by a hash of the id. The feature vectors of the sample are what the driver gets.

Null texts and texts without a letter are ``und`` with score 0, and so is everything if there are no labels. A null id
is never held out and never trained on. Whole texts are read. Extra columns are ignored.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pipelake.llm.common import hash_sample, sample_share

#: Families of languages by code; a language that is not listed is a family of its own.
FAMILIES = {
    "germanic": ("en", "de", "nl", "sv", "da", "no", "nb", "nn", "is", "af"),
    "romance": ("fr", "es", "it", "pt", "ro", "ca", "gl", "oc"),
    "slavic": ("ru", "uk", "be", "bg", "sr", "hr", "bs", "sl", "cs", "sk", "pl", "mk"),
    "finnic": ("fi", "et"),
    "indic": ("hi", "bn", "ur", "mr", "ne", "pa", "gu"),
    "turkic": ("tr", "az", "kk", "uz"),
    "semitic": ("ar", "he", "fa"),
    "sinitic": ("zh", "yue"),
}
DIMENSIONS = 1 << 12
_LETTERS = bytes(b if b >= 128 or chr(b).isalpha() else 32 for b in range(256))


def family_of(language: str) -> str:
    return next((name for name, members in FAMILIES.items() if language in members), f"only {language}")


def features(text: str) -> np.ndarray:
    """Unit vector of the square roots of hashed n-gram counts."""
    codes = np.frombuffer(b" " + text.encode().lower().translate(_LETTERS) + b" ", np.uint8).astype(np.uint32)
    pair = codes[:-1] * np.uint32(0x9E3779B1) + codes[1:] * np.uint32(0x85EBCA77)
    triple = pair[:-1] * np.uint32(0xC2B2AE3D) + codes[2:] * np.uint32(0x27D4EB2F)
    four = triple[:-1] * np.uint32(0x165667B1) + codes[3:] * np.uint32(0x9E3779B1)
    shift = np.uint32(32 - DIMENSIONS.bit_length() + 1)
    grams = np.concatenate([(x * np.uint32(0x9E3779B1)) >> shift for x in (pair, triple, four)])
    vector = np.sqrt(np.bincount(grams, minlength=DIMENSIONS)).astype(np.float32)
    return vector / max(float(np.linalg.norm(vector)), 1e-9)


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


def fit_svm(x: np.ndarray, positive: np.ndarray, *, epochs: int = 12, regular: float = 1e-4, seed: int = 5) -> np.ndarray:
    """Weights of a linear SVM (hinge loss, averaged stochastic subgradients, balanced classes); the last one is the bias."""
    sign = np.where(positive, 1.0, -1.0).astype(np.float32)
    share = np.where(positive, 0.5 / max(positive.sum(), 1), 0.5 / max((~positive).sum(), 1)) * len(x)
    data = np.hstack([x, np.ones((len(x), 1), np.float32)])
    weights, mean, rng, step = np.zeros(data.shape[1]), np.zeros(data.shape[1]), np.random.default_rng(seed), 0
    for _ in range(epochs):
        for part in np.array_split(rng.permutation(len(x)), max(1, len(x) // 32)):
            step += 1
            rate = 1.0 / (regular * (step + 1000))
            wrong = part[sign[part] * (data[part] @ weights) < 1]
            weights *= 1 - rate * regular
            weights += rate / len(part) * ((sign[wrong] * share[wrong])[:, None] * data[wrong]).sum(axis=0)
            mean += (weights - mean) / step
    return mean


@dataclass(frozen=True)
class LanguageModel:
    """Families with their languages, one row of weights per family, and one per pair of languages of a family."""

    families: list[tuple[str, list[str]]]
    family_weights: np.ndarray
    pairs: dict[tuple[str, str], np.ndarray]

    def predict(self, x: np.ndarray) -> tuple[list[str], np.ndarray]:
        data = np.hstack([x, np.ones((len(x), 1), np.float32)])
        languages, scores = np.empty(len(x), object), np.ones(len(x))
        best = np.zeros(len(x), np.int64)
        if len(self.families) > 1:
            margins = data @ self.family_weights.T
            best = margins.argmax(axis=1)
            ordered = np.sort(margins, axis=1)
            scores *= _sure(ordered[:, -1] - ordered[:, -2])
        for i, (_, members) in enumerate(self.families):
            rows = np.flatnonzero(best == i)
            votes, sums = np.zeros((len(rows), len(members))), np.zeros((len(rows), len(members)))
            for (a, j), (b, k) in itertools.combinations([(m, j) for j, m in enumerate(members)], 2):
                margin = data[rows] @ self.pairs[a, b]
                votes[:, j] += margin >= 0
                votes[:, k] += margin < 0
                sums[:, j] += margin
                sums[:, k] -= margin
            order = np.argmax(votes + np.tanh(sums) / 4, axis=1)
            languages[rows] = [members[j] for j in order]
            if len(members) > 1:
                scores[rows] *= _sure(sums[np.arange(len(rows)), order] / (len(members) - 1) * 2)
        return list(languages), scores


def _sure(margin: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(2 * margin, -30, 30)))


def fit(x: np.ndarray, languages: np.ndarray) -> LanguageModel:
    names = sorted(set(languages))
    families = [(f, [n for n in names if family_of(n) == f]) for f in sorted({family_of(n) for n in names})]
    of = np.array([family_of(n) for n in languages])
    rows = [fit_svm(x, of == f) for f, _ in families] if len(families) > 1 else [np.zeros(x.shape[1] + 1)]
    pairs = {}
    for _, members in families:
        for a, b in itertools.combinations(members, 2):
            chosen = (languages == a) | (languages == b)
            pairs[a, b] = fit_svm(x[chosen], languages[chosen] == a)
    return LanguageModel(families, np.array(rows), pairs)


def train(labelled: DataFrame, *, key: str, text: str, language: str, train_docs: int = 800) -> LanguageModel | None:
    """Fit on about ``train_docs`` rows per language of ``labelled``; None if there are none."""
    counts = {r[0]: r[1] for r in labelled.where(F.col(language).isNotNull()).groupBy(language).count().collect()}
    if not counts:
        return None
    chosen = F.lit(False)
    for name, n in counts.items():
        chosen = F.when(F.col(language) == name, hash_sample(F.col(key).cast("string"), sample_share(n, train_docs))).otherwise(chosen)

    def vectors(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            batch = batch[[has_letter(t) for t in batch["text"]]]
            rows = [features(t) for t in batch["text"]]
            hot = [np.flatnonzero(r) for r in rows]
            yield pd.DataFrame({
                "language": batch["language"],
                "at": [h.astype("<u2").tobytes() for h in hot],
                "value": [r[h].astype("<f4").tobytes() for r, h in zip(rows, hot, strict=True)],
            })

    sample = labelled.where(chosen).select(F.col(language).alias("language"), F.col(text).alias("text"))
    rows = sample.mapInPandas(vectors, "language string, at binary, value binary").collect()
    if not rows:
        return None
    rows.sort(key=lambda r: (r.language, bytes(r.at), bytes(r.value)))
    x = np.zeros((len(rows), DIMENSIONS), np.float32)
    for i, row in enumerate(rows):
        x[i, np.frombuffer(row.at, "<u2")] = np.frombuffer(row.value, "<f4")
    return fit(x, np.array([r.language for r in rows]))


def predicted(model: LanguageModel | None, text: Column, spark) -> Column:
    """Struct (lang_pred, score). The broadcast model has a fixed size per language and pair."""
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double")
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        model = shared.value
        for batch in batches:
            names, scores = ["und"] * len(batch), np.zeros(len(batch))
            known = [i for i, t in enumerate(batch) if has_letter(t)] if model else []
            texts = batch.tolist()
            for at in range(0, len(known), 256):
                part = known[at : at + 256]
                found, sure = model.predict(np.stack([features(texts[i]) for i in part]))
                scores[part] = sure
                for i, name in zip(part, found, strict=True):
                    names[i] = name
            yield pd.DataFrame({"lang_pred": names, "score": scores})

    return predict(text)


def identify(docs: DataFrame, *, key: str = "doc_id", text: str = "text", language: str = "lang", train_docs: int = 800, folds: int = 5) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every row; rows whose crc32(id) is divisible by ``folds`` are never trained on."""
    fold = F.crc32(F.col(key).cast("string")) % folds
    model = train(docs.where(fold != 0).select(key, text, language), key=key, text=text, language=language, train_docs=train_docs)
    found = docs.select(F.col(key).alias("doc_id"), F.coalesce(fold == 0, F.lit(False)).alias("held_out"), predicted(model, F.col(text), docs.sparkSession).alias("p"))
    return found.select("doc_id", "held_out", "p.lang_pred", "p.score")
