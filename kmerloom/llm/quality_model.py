"""Quality classifier: histogram gradient-boosted trees over document statistics.

The trees are fitted on a bounded sample of labelled documents
(``TRAIN_ROWS`` in expectation, chosen by a hash of the key), kept as flat
arrays in heap order, and applied to every document by numpy, one level of
all trees at a time.

Defined results: a null text counts as empty, and an empty text is scored
from zero statistics; several labels of a document are averaged; without
any label of one of the two kinds every score is the share of good labels
(1.0 if there are none); repeated rows are scored once each.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kmerloom.llm.common import key_mod, sampled, small_batches

#: Expected number of labelled documents to fit on.
TRAIN_ROWS = 20_000
FOLDS, TEST_FOLD = 5, 0
CUTOFF = 0.3
TREES, DEPTH, RATE, BINS, L2, MIN_WEIGHT = 60, 4, 0.15, 64, 1.0, 5.0

STATISTICS = (
    "log_bytes", "log_words", "log_lines", "mean_word", "std_word", "longest_word", "distinct_words",
    "repeated_windows", "repeated_lines", "words_a_line", "short_lines", "ended_lines", "capital_words",
    "upper", "lower", "digits", "spaces", "symbols", "bars", "exclamations", "stops", "other_ascii", "wide", "entropy",
)


def _classes() -> np.ndarray:
    table = np.zeros((256, 11))
    sets = [
        range(65, 91),
        range(97, 123),
        range(48, 58),
        b" \t\n\x0b\x0c\r",
        b"#*$%&<>",
        b"|",
        b"!",
        b".,;:?",
    ]
    for j, chars in enumerate(sets):
        table[list(chars), j] = 1
    table[:128, 8] = 1 - table[:128, :8].sum(1)
    table[128:, 9] = 1
    return table


_CLASSES = _classes()


def statistics(text: str | None) -> np.ndarray:
    """The statistics of one whole text, in the order of ``STATISTICS``."""
    data = (text or "").encode("utf-8", "surrogatepass")
    out = np.zeros(len(STATISTICS))
    if not data:
        return out
    counts = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    words = data.split()
    lines = [x for x in data.split(b"\n") if x.strip()]
    n, share = len(words), counts / len(data)
    classes = counts @ _CLASSES / len(data)
    used = share[share > 0]
    out[0], out[1], out[2] = np.log1p(len(data)), np.log1p(n), np.log1p(len(lines))
    if n:
        sizes = np.fromiter(map(len, words), np.float64, n)
        out[3], out[4], out[5] = sizes.mean(), sizes.std(), np.log1p(sizes.max())
        out[6] = len(set(words)) / n
        if n > 2:
            h = np.fromiter(map(hash, words), np.int64, n)
            with np.errstate(over="ignore"):
                windows = h[:-2] * np.int64(1_000_003) + h[1:-1] * np.int64(998_244_353) + h[2:]
            out[7] = 1 - len(np.unique(windows)) / len(windows)
        out[8] = 1 - len(set(lines)) / len(lines)
        out[9] = np.log1p(n / len(lines))
        out[10] = sum(len(x) < 30 for x in lines) / len(lines)
        out[11] = sum(x.rstrip()[-1:] in (b".", b"!", b"?") for x in lines) / len(lines)
        out[12] = sum(w[:1].isupper() for w in words) / n
    out[13:23] = classes[:10]
    out[23] = -(used * np.log2(used)).sum()
    return out


@dataclass
class Trees:
    """Trees of one depth as arrays of one row a tree, nodes in heap order; a node sends greater values right."""

    feature: np.ndarray
    threshold: np.ndarray
    leaf: np.ndarray
    prior: float

    def raw(self, x: np.ndarray) -> np.ndarray:
        depth = int(np.log2(self.leaf.shape[1])) if self.leaf.size else 0
        tree = np.arange(len(self.feature))[None, :]
        rows = np.arange(len(x))[:, None]
        node = np.zeros((len(x), len(self.feature)), np.int64)
        for _ in range(depth):
            node = 2 * node + 1 + (x[rows, self.feature[tree, node]] > self.threshold[tree, node])
        return self.prior + self.leaf[tree, node - (2**depth - 1)].sum(1)

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(x), -60, 60)))


def _edges(column: np.ndarray, bins: int) -> np.ndarray:
    """Ascending cuts between values, so that about equal numbers fall between two."""
    return np.unique(np.quantile(column, np.arange(1, bins) / bins, method="lower"))


def fit(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, rate: float = RATE, bins: int = BINS, l2: float = L2, min_weight: float = MIN_WEIGHT) -> Trees:
    """Boost trees on the logistic loss; splits come from histograms of gradients and curvatures."""
    good = y.mean() if len(y) else 1.0
    prior = float(np.log(np.clip(good, 1e-9, 1 - 1e-9) / np.clip(1 - good, 1e-9, 1)))
    inner, leaves = 2**depth - 1, 2**depth
    if not 0 < good < 1:
        return Trees(np.zeros((0, inner), int), np.zeros((0, inner)), np.zeros((0, leaves)), prior)
    n, width = x.shape
    cuts = [_edges(x[:, f], bins) for f in range(width)]
    binned = np.stack([np.searchsorted(c, x[:, f], side="left") for f, c in enumerate(cuts)], 1)
    last = np.array([len(c) for c in cuts])  # splits of a feature: bins up to b go left, b < last
    shift = np.arange(width) * bins
    raw = np.full(n, prior)
    features, thresholds, values = [], [], []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-raw))
        g, h = p - y, p * (1 - p)
        node = np.zeros(n, np.int64)
        feature, threshold = np.zeros(inner, int), np.full(inner, np.inf)
        for level in range(depth):
            first, count = 2**level - 1, 2**level
            cell = (((node - first) * width * bins)[:, None] + shift + binned).ravel()
            size = count * width * bins
            sums = [np.bincount(cell, np.repeat(v, width), size).reshape(count, width, bins) for v in (g, h)]
            gl, hl = sums[0].cumsum(2), sums[1].cumsum(2)
            gt, ht = gl[:, :, -1:], hl[:, :, -1:]
            gain = gl**2 / (hl + l2) + (gt - gl) ** 2 / (ht - hl + l2) - gt**2 / (ht + l2)
            allowed = (np.arange(bins) < last[:, None])[None] & (hl >= min_weight) & (ht - hl >= min_weight)
            gain = np.where(allowed, gain, 0).reshape(count, -1)
            best = gain.argmax(1)
            for k in np.flatnonzero(gain[np.arange(count), best] > 1e-9):
                f, b = divmod(int(best[k]), bins)
                feature[first + k], threshold[first + k] = f, cuts[f][b]
            node = 2 * node + 1 + (x[np.arange(n), feature[node]] > threshold[node])
        at = node - inner
        leaf = -rate * np.bincount(at, g, leaves) / (np.bincount(at, h, leaves) + l2)
        raw += leaf[at]
        features.append(feature)
        thresholds.append(threshold)
        values.append(leaf)
    return Trees(np.array(features), np.array(thresholds), np.array(values), prior)


def _with_statistics(rows: DataFrame, columns: str, trees: Trees | None) -> DataFrame:
    """Rows with text to rows with their statistics, or with their score if trees are given."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            x = np.array([statistics(t) for t in batch["text"]]).reshape(-1, len(STATISTICS))
            out = batch.drop(columns="text")
            if trees is None:
                out["x"] = list(x)
            else:
                out["score"] = np.concatenate([trees.score(x[i : i + 4096]) for i in range(0, len(x), 4096)]) if len(x) else []
            yield out

    return rows.mapInPandas(run, f"{columns}, x array<double>" if trees is None else f"{columns}, score double")


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", rows: int = TRAIN_ROWS) -> Trees:
    """Fit on the labelled documents whose crc32(key) mod 5 is not 0; about ``rows`` of them."""
    small_batches(docs.sparkSession)
    known = labels.where(F.col(key).isNotNull() & F.col(label).isNotNull() & (key_mod(F.col(key), FOLDS) != TEST_FOLD))
    known = known.groupBy(F.col(key).alias("k")).agg((F.avg(F.col(label).cast("double")) >= 0.5).cast("double").alias("y"))
    n = known.count()
    if not n:
        return fit(np.zeros((0, len(STATISTICS))), np.zeros(0))
    chosen = known.where(sampled(rows / n, "k", seed=7))
    # the sample is bounded by ``rows`` in expectation, so it can go to every task
    narrow = docs.select(F.col(key).cast("long").alias("k"), F.col(text).alias("text"))
    sample = narrow.join(F.broadcast(chosen.withColumn("k", F.col("k").cast("long"))), "k").select("k", "y", "text").dropDuplicates()
    got = _with_statistics(sample, "k bigint, y double", None).toPandas().sort_values("k", kind="stable")
    if got.empty:
        return fit(np.zeros((0, len(STATISTICS))), np.zeros(0))
    return fit(np.stack(got["x"].to_numpy()), got["y"].to_numpy())


def score(docs: DataFrame, trees: Trees, key: str = "doc_id", text: str = "text", cutoff: float = CUTOFF) -> DataFrame:
    """``doc_id``, ``held_out``, ``score`` and ``predicted`` of every document."""
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    rows = rows.select("doc_id", (key_mod(F.col("doc_id"), FOLDS) == TEST_FOLD).alias("held_out"), "text")
    out = _with_statistics(rows, "doc_id bigint, held_out boolean", trees)
    return out.withColumn("predicted", (F.col("score") >= cutoff).cast("int"))


def classify(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """Train on the labelled documents and score all."""
    return score(docs, train(docs, labels, **options))


def keep_good(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", cutoff: float = CUTOFF, **options) -> DataFrame:
    """The documents that the classifier does not reject, with all their columns."""
    trees = train(docs, labels, key=key, text=text, **options)

    @F.pandas_udf("double")
    def scored(texts: pd.Series) -> pd.Series:
        x = np.array([statistics(t) for t in texts]).reshape(-1, len(STATISTICS))
        return pd.Series(np.concatenate([trees.score(x[i : i + 4096]) for i in range(0, len(x), 4096)]) if len(x) else [], dtype="float64")

    return docs.where(scored(F.col(text)) >= cutoff)
