"""Language identification by sparse multinomial logistic regression.

Character n-grams are hashed to a fixed number of features and weighted by
TF-IDF; document frequencies come from all training documents.  Weights are
fitted by follow-the-regularised-leader with an elastic-net penalty on a
bounded sample (``TRAIN_DOCS`` a language in expectation), and a temperature
fitted on a part of the sample that training leaves out calibrates the
probabilities.

Defined results: a text that is null or holds no letter is ``und`` with
score 0; without any training document every text is ``und``; repeated rows
are predicted once each; rows with a null language train nothing.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kmerloom.llm.common import key_mod, sampled, small_batches

FOLDS, TEST_FOLD = 3, 1
UNKNOWN = "und"
#: Expected number of training documents a language.
TRAIN_DOCS = 1000
FEATURES = 1 << 15
ORDERS = (1, 2, 3)
EPOCHS, ALPHA, BETA, L1, L2 = 3, 0.5, 1.0, 0.02, 0.01

_LETTER: np.ndarray | None = None


def _letters() -> np.ndarray:
    global _LETTER
    if _LETTER is None:
        _LETTER = np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)
    return _LETTER


def ngrams(text: str | None) -> np.ndarray | None:
    """Counts of the hashed n-grams of a whole text's words; None if it has no letter."""
    if not text:
        return None
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4")
    letter = _letters()[points]
    if not letter.any():
        return None
    # anything but letters separates words; one separator stands at either end and between words
    clean = np.concatenate([[32], np.where(letter, points, 32), [32]]).astype(np.uint64)
    clean = clean[np.concatenate([[True], (clean[1:] != 32) | (clean[:-1] != 32)])]
    counts = np.zeros(FEATURES, np.int64)
    with np.errstate(over="ignore"):
        for n in ORDERS:
            if len(clean) < n:
                break
            h = np.full(len(clean) - n + 1, n, np.uint64)
            for j in range(n):
                h = (h ^ clean[j : len(clean) - n + 1 + j]) * np.uint64(0x9E3779B97F4A7C15)
                h ^= h >> np.uint64(29)
            counts += np.bincount((h >> np.uint64(17)).astype(np.int64) & (FEATURES - 1), minlength=FEATURES)
    return counts


@dataclass
class Model:
    languages: list[str]
    idf: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    temperature: float = 1.0

    def vector(self, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.flatnonzero(counts)
        v = np.log1p(counts[at]) * self.idf[at]
        return at, v / max(float(np.sqrt(v @ v)), 1e-12)

    def logits(self, at: np.ndarray, v: np.ndarray) -> np.ndarray:
        return v @ self.weights[at] + self.bias

    def predict(self, text: str | None) -> tuple[str, float]:
        counts = ngrams(text) if self.languages else None
        if counts is None:
            return UNKNOWN, 0.0
        p = _softmax(self.logits(*self.vector(counts)) / self.temperature)
        best = int(p.argmax())
        return self.languages[best], float(p[best])


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max())
    return e / e.sum()


def _ftrl(model: Model, vectors: list, labels: np.ndarray) -> None:
    """Per-coordinate follow-the-regularised-leader on the softmax loss; the bias has no penalty."""
    width, k = model.weights.shape
    z, n = np.zeros((width, k)), np.zeros((width, k))
    zb, nb = np.zeros(k), np.zeros(k)
    order = np.random.default_rng(0)

    def leader(zs: np.ndarray, ns: np.ndarray, l1: float, l2: float) -> np.ndarray:
        return np.where(np.abs(zs) <= l1, 0, -(zs - np.sign(zs) * l1) / ((BETA + np.sqrt(ns)) / ALPHA + l2))

    for _ in range(EPOCHS):
        for i in order.permutation(len(vectors)):
            at, v = vectors[i]
            w, wb = leader(z[at], n[at], L1, L2), leader(zb, nb, 0, 0)
            p = _softmax(v @ w + wb)
            p[labels[i]] -= 1
            g = v[:, None] * p
            z[at] += g - (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / ALPHA * w
            n[at] += g * g
            zb += p - (np.sqrt(nb + p * p) - np.sqrt(nb)) / ALPHA * wb
            nb += p * p
    model.weights, model.bias = leader(z, n, L1, L2), leader(zb, nb, 0, 0)


def _temperature(logits: np.ndarray, labels: np.ndarray) -> float:
    """The temperature of the least log loss, by golden-section search on its logarithm."""

    def loss(t: float) -> float:
        x = logits / np.exp(t)
        x = x - x.max(1, keepdims=True)
        return float((np.log(np.exp(x).sum(1)) - x[np.arange(len(x)), labels]).mean())

    lo, hi, r = np.log(0.02), np.log(20.0), (5**0.5 - 1) / 2
    for _ in range(50):
        a, b = hi - r * (hi - lo), lo + r * (hi - lo)
        lo, hi = (lo, b) if loss(a) < loss(b) else (a, hi)
    return float(np.exp((lo + hi) / 2))


def _frequencies(rows: DataFrame) -> np.ndarray:
    """In how many of the texts each feature occurs."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(FEATURES, np.int64)
        for batch in batches:
            for t in batch["text"]:
                counts = ngrams(t)
                if counts is not None:
                    total += counts > 0
        at = np.flatnonzero(total)
        yield pd.DataFrame({"feature": at, "n": total[at]})

    out = np.zeros(FEATURES, np.int64)
    for r in rows.select("text").mapInPandas(run, "feature bigint, n bigint").groupBy("feature").agg(F.sum("n").alias("n")).collect():
        out[r["feature"]] = r["n"]
    return out


def _sample(rows: DataFrame) -> pd.DataFrame:
    """Key, language and packed n-gram counts of the texts with a letter."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            got = []
            for k, lang, t in batch[["doc_id", "lang", "text"]].itertuples(index=False):
                counts = ngrams(t)
                if counts is not None:
                    at = np.flatnonzero(counts)
                    got.append((k, lang, at.astype("<u4").tobytes(), counts[at].astype("<i8").tobytes()))
            yield pd.DataFrame(got, columns=["doc_id", "lang", "at", "n"])

    return rows.mapInPandas(run, "doc_id bigint, lang string, at binary, n binary").toPandas()


def train(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", docs_a_language: int = TRAIN_DOCS) -> Model:
    """Fit on documents with a language whose crc32(key) mod 3 is not 1."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"), F.col(lang).cast("string").alias("lang"))
    rows = rows.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (key_mod(F.col("doc_id"), FOLDS) != TEST_FOLD))
    sizes = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    if not sizes:
        return Model([], np.zeros(FEATURES), np.zeros((FEATURES, 0)), np.zeros(0))
    languages = sorted(sizes)
    shares = F.create_map(*[F.lit(x) for k in languages for x in (k, docs_a_language / sizes[k])])
    # copies of a row are one row of the sample, however many they are
    some = rows.where(sampled(shares[F.col("lang")], "doc_id", "text")).dropDuplicates(["doc_id", "lang", "text"])
    sample = _sample(some).sort_values(["doc_id", "at", "n"], kind="stable", ignore_index=True)
    total = sum(sizes.values())
    idf = np.log((1 + total) / (1 + _frequencies(rows))) + 1
    model = Model(languages, idf, np.zeros((FEATURES, len(languages))), np.zeros(len(languages)))
    vectors = []
    for at, n in zip(sample["at"], sample["n"], strict=True):
        counts = np.zeros(FEATURES, np.int64)
        counts[np.frombuffer(at, "<u4")] = np.frombuffer(n, "<i8")
        vectors.append(model.vector(counts))
    labels = np.array([languages.index(x) for x in sample["lang"]], int)
    part = np.arange(len(labels)) % 5 == 4
    _ftrl(model, [v for v, p in zip(vectors, part, strict=True) if not p], labels[~part])
    if part.any():
        model.temperature = _temperature(np.array([model.logits(*v) for v, p in zip(vectors, part, strict=True) if p]), labels[part])
    model.weights = model.weights.astype(np.float32)
    return model


def predict(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id``, ``held_out``, ``lang_pred`` and ``score`` of every document."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            got = [model.predict(t) for t in batch["text"]]
            out = batch.drop(columns="text")
            out["lang_pred"], out["score"] = [g[0] for g in got], [g[1] for g in got]
            yield out

    small_batches(docs.sparkSession)
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    rows = rows.select("doc_id", (key_mod(F.col("doc_id"), FOLDS) == TEST_FOLD).alias("held_out"), "text")
    return rows.mapInPandas(run, "doc_id bigint, held_out boolean, lang_pred string, score double")


def identify(docs: DataFrame, **options) -> DataFrame:
    """Train on the documents that may teach and predict all."""
    return predict(docs, train(docs, **options))
