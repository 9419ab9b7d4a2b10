"""Quality classifier: histogram gradient-boosted trees over document statistics.

The trees are complete, so the ensemble is three arrays (feature, threshold, leaf) and a batch of documents walks all
trees at once with array indexing.
"""

from __future__ import annotations

import operator
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, id_hash, slices, texts_of

#: Labelled documents that the trees are fitted on, at most (by hash of the id).
MAX_ROWS = 20_000
BINS, DEPTH, TREES, RATE, SHRINK = 64, 4, 60, 0.2, 1.0
KEEP_FROM = 0.7
FEATURES = (
    "log_bytes", "log_words", "word_bytes", "long_words", "short_words", "upper", "lower", "digit", "symbol",
    "pipe", "exclaim", "stop_mark", "comma", "blank", "newline", "other_mark", "wide", "distinct_words", "top_word",
    "same_next", "lines", "dup_lines", "line_bytes", "byte_entropy", "marked_words",
)


def _classes() -> np.ndarray:
    """Byte -> class, for shares of bytes."""
    out = np.full(256, 9)
    out[ord("A") : ord("Z") + 1], out[ord("a") : ord("z") + 1], out[ord("0") : ord("9") + 1] = 0, 1, 2
    for at, chars in ((3, b"#*$%&<>"), (4, b"|"), (5, b"!"), (6, b".?;:"), (7, b","), (8, b" \t\r\x0b\x0c"), (10, b"\n")):
        out[list(chars)] = at
    out[128:] = 11
    return out


_CLASS = _classes()


def statistics(text: str) -> list[float]:
    """The values of FEATURES; an empty text has zeros."""
    return _measured(text)[0]


def _measured(text: str) -> tuple[list[float], int]:
    """The values of FEATURES and the number of words."""
    raw = text.encode("utf-8", "replace")
    n = len(raw)
    if not n:
        return [0.0] * len(FEATURES), 0
    by_byte = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    share = np.bincount(_CLASS, by_byte, 12) / n
    p = by_byte[by_byte > 0] / n
    words = raw.split()
    k = len(words)
    sizes = np.fromiter(map(len, words), np.int64, k) if k else np.zeros(1, np.int64)
    counts = Counter(words)
    lines = [x for x in raw.split(b"\n") if x.strip()]
    per = max(k, 1)
    marked = int(np.count_nonzero(np.isin(np.frombuffer(b"".join(w[-1:] for w in words), np.uint8), _MARKS)))
    return [
        np.log1p(n), np.log1p(k), sizes.mean(), np.count_nonzero(sizes > 12) / per, np.count_nonzero(sizes < 3) / per,
        share[0], share[1], share[2], share[3], share[4], share[5], share[6], share[7], share[8], share[10], share[9],
        share[11], len(counts) / per, max(counts.values(), default=0) / per,
        sum(map(operator.eq, words, islice(words, 1, None))) / per, np.log1p(len(lines)),
        1 - len(set(lines)) / max(len(lines), 1), n / max(len(lines), 1), float(-(p * np.log(p)).sum()), marked / per,
    ], k


_MARKS = np.frombuffer(b"#*$%&|<>!", np.uint8)


@dataclass
class Trees:
    """``feature`` and ``threshold``: (trees, 2^DEPTH - 1) in heap order; ``leaf``: (trees, 2^DEPTH)."""

    feature: np.ndarray
    threshold: np.ndarray
    leaf: np.ndarray
    prior: float

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        """Rows of statistics -> log odds; all rows walk all trees together."""
        trees = np.arange(self.feature.shape[0])
        node = np.zeros((len(x), len(trees)), np.int64)
        row = np.arange(len(x))[:, None]
        depth = int(np.log2(self.leaf.shape[1])) if len(trees) else 0
        for _ in range(depth):
            node = 2 * node + 1 + (x[row, self.feature[trees, node]] > self.threshold[trees, node])
        return self.prior + self.leaf[trees, node - (self.leaf.shape[1] - 1)].sum(1) if len(trees) else np.full(len(x), self.prior)


def boost(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH) -> Trees:
    """Log-loss boosting on binned features; without rows or with one class only the prior remains."""
    ones = float(y.sum())
    prior = float(np.log((ones + 0.5) / (len(y) - ones + 0.5)))
    inner, leaves = (1 << depth) - 1, 1 << depth
    out = Trees(np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, leaves)), prior)
    if not 0 < ones < len(y):
        return out
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS)[1:-1])) for j in range(x.shape[1])]
    binned = np.stack([np.searchsorted(e, x[:, j], "left") for j, e in enumerate(edges)], 1)
    width = x.shape[1]
    odds = np.full(len(y), prior)
    grown = ([], [], [])
    for _ in range(trees):
        p = 1 / (1 + np.exp(-odds))
        g, h = y - p, p * (1 - p)
        feature, threshold = np.zeros(inner, np.int64), np.full(inner, np.inf)
        node = np.zeros(len(y), np.int64)
        for level in range(depth):
            first, n_nodes = (1 << level) - 1, 1 << level
            local = node - first
            best = np.full(n_nodes, 1e-9)
            cut = np.full(n_nodes, -1)
            total_g = np.bincount(local, g, n_nodes)[:, None]
            total_h = np.bincount(local, h, n_nodes)[:, None]
            for j in range(width):
                cell = local * BINS + binned[:, j]
                left_g = np.bincount(cell, g, n_nodes * BINS).reshape(n_nodes, BINS).cumsum(1)
                left_h = np.bincount(cell, h, n_nodes * BINS).reshape(n_nodes, BINS).cumsum(1)
                right_g, right_h = total_g - left_g, total_h - left_h
                gain = left_g**2 / (left_h + SHRINK) + right_g**2 / (right_h + SHRINK) - total_g**2 / (total_h + SHRINK)
                gain[(left_h < 1) | (right_h < 1)] = -1
                gain[:, len(edges[j]) :] = -1
                at = gain.argmax(1)
                won = gain[np.arange(n_nodes), at] > best
                best[won], cut[won] = gain[np.arange(n_nodes), at][won], at[won]
                feature[first : first + n_nodes][won] = j
            there = cut >= 0
            ids = first + np.flatnonzero(there)
            threshold[ids] = [edges[feature[i]][cut[i - first]] for i in ids]
            node = 2 * node + 1 + (x[np.arange(len(y)), feature[node]] > threshold[node])
        leaf_at = node - inner
        leaf = RATE * np.bincount(leaf_at, g, leaves) / (np.bincount(leaf_at, h, leaves) + SHRINK)
        odds += leaf[leaf_at]
        for into, value in zip(grown, (feature, threshold, leaf), strict=True):
            into.append(value)
    return Trees(np.array(grown[0]), np.array(grown[1]), np.array(grown[2]), prior)


def training_rows(docs: DataFrame, labels: DataFrame, max_rows: int) -> DataFrame:
    """(doc_id, text, label) of at most ``max_rows`` labelled documents; the ids are bounded, so they are broadcast.

    Of documents that share an id one text counts, that of the least hash.
    """
    some = labels.where("label is not null").orderBy(F.xxhash64("doc_id"), "doc_id", "label").limit(max_rows)
    found = docs.select("doc_id", "text").join(F.broadcast(some), "doc_id")
    return found.groupBy("doc_id", "label").agg(F.min_by("text", F.xxhash64("text")).alias("text")).select("doc_id", "text", "label")


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> Trees:
    """Trees from documents and (doc_id, label); their statistics are computed on the executors."""
    bound_batches(docs.sparkSession)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            x = [statistics(t) for t in texts_of(batch)]
            yield pa.record_batch(
                [pa.array(x, pa.list_(pa.float64())), pa.array(batch.column("label").to_pylist(), pa.float64())], names=["x", "y"]
            )

    rows = training_rows(docs, labels, max_rows).mapInArrow(measure, "x array<double>, y double").toArrow()
    x = np.array(rows["x"].to_pylist()).reshape(-1, len(FEATURES))
    y = rows["y"].to_numpy()
    order = np.lexsort([*x.T, y])  # the same rows give the same trees, in whatever order they arrive
    return boost(x[order], y[order])


def score(docs: DataFrame, trees: Trees, keep_from: float = KEEP_FROM, text_col: str = "text", with_text: bool = False) -> DataFrame:
    """``docs`` with ``score`` (0 to 1), ``predicted`` (1 from ``keep_from``) and ``n_words``.

    Null counts as empty, and empty texts are scored by their zero statistics.  Repeated rows are scored alike.
    Other columns pass through, the text too if ``with_text``; columns already called as the new ones are replaced.
    """
    bound_batches(docs.sparkSession)
    told = docs.sparkSession.sparkContext.broadcast(trees)
    docs = docs.drop("score", "predicted", "n_words")
    names = [c for c in docs.columns if with_text or c != text_col]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name in names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = [_measured(t) for t in texts_of(batch, text_col)]
            x = np.array([f for f, _ in found]).reshape(-1, len(FEATURES))
            p = 1 / (1 + np.exp(-told.value.log_odds(x)))
            more = [pa.array(p), pa.array((p >= keep_from).astype(np.int32)), pa.array([k for _, k in found], pa.int64())]
            yield pa.record_batch([*[batch.column(c) for c in names], *more], names=[*names, "score", "predicted", "n_words"])

    return docs.mapInArrow(run, f"{schema}, score double, predicted int, n_words long")


def _held_out(c: str) -> Column:
    return F.coalesce(F.pmod(id_hash(F.col(c)), F.lit(4)) == 2, F.lit(False))


def fit_quality(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> Trees:
    """Trees for ``labels.quality`` outside the held-out quarter: crc32 of the id as text leaves 2 modulo 4."""
    known = labels.where(~_held_out("doc_id")).select("doc_id", F.col("quality").cast("double").alias("label"))
    return fit(docs, known, max_rows)


def classify(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> DataFrame:
    """Learns ``quality`` outside the held-out quarter and scores all documents: doc_id, held_out, score, predicted.

    Held out: crc32 of the id as text leaves 2 modulo 4.  Null ids are not held out and have no labels.  Null and empty
    texts are scored by their zero statistics; whole texts are read; repeated rows are scored alike, and a score of exactly
    KEEP_FROM is predicted 1.  An empty table gives an empty result.
    """
    trees = fit_quality(docs, labels, max_rows)
    return score(docs.select("doc_id", _held_out("doc_id").alias("held_out"), "text"), trees).drop("n_words")
