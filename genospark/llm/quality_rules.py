"""Quality rules: fixed thresholds on counts of a document, and on a calibrated probability of good quality.

The probability comes from a logistic regression on hashed word and character n-grams.  A document's features are the
shares of its n-grams in each hash slot, so its log odds are the mean weight of its n-grams: scoring a batch is array
lookups over the concatenated texts.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, id_hash, slices, texts_of
from .quality_trees import training_rows

SLOTS_BITS = 16
SLOTS = 1 << SLOTS_BITS
#: Blocks of slots: word 1- and 2-grams, character 2- and 3-grams.
BLOCKS = 4
#: Labelled documents of the fit at most; every CALIBRATE-th of them is left for the calibration.
MAX_ROWS, CALIBRATE = 6_000, 4
MIN_WORDS, MAX_REPEAT_PERCENT, WINDOW, KEEP_FROM = 20, 30, 8, 0.5
SYMBOLS = "#*$%&|<>"
_MIX = np.uint64(0x9E3779B97F4A7C15)
_FEATURE_SCALE = np.float32(32.0)
#: Bytes that a worker's word numbers take at most before it starts anew; a word costs ``_ENTRY`` beside its own.
_INTERN_BYTES, _ENTRY = 64 << 20, 160


class Words(dict):
    """Word -> number, in order of appearance; ``hashes`` has the word's crc32 by number."""

    def __init__(self):
        super().__init__()
        self.hashes, self.bytes = np.zeros(1 << 16, np.uint64), 0

    def __missing__(self, word: bytes) -> int:
        at = self[word] = len(self)
        if at >= len(self.hashes):
            self.hashes = np.concatenate([self.hashes, np.zeros_like(self.hashes)])
        self.hashes[at] = zlib.crc32(word)
        self.bytes += len(word) + _ENTRY
        return at

    def ids(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.int64, len(words))


def repeated_words(ids: np.ndarray, window: int = WINDOW) -> int:
    """Words that lie in windows of 8 found twice or more, the first included.  Exact: equal codes are equal windows."""
    n = len(ids)
    if n <= window:
        return 0
    pairs = ids[:-1] * (1 << 31) + ids[1:]
    _, code, times = np.unique(pairs, return_inverse=True, return_counts=True)
    again = times[code] > 1
    last = n - window + 1
    at = np.flatnonzero(again[:last] & again[2 : last + 2] & again[4 : last + 4] & again[6 : last + 6])
    if not len(at):
        return 0
    # Codes of four words, then of eight, for the windows that may repeat.
    fours = np.concatenate([code[at] * n + code[at + 2], code[at + 4] * n + code[at + 6]])
    _, four = np.unique(fours, return_inverse=True)
    _, eight, times = np.unique(four[: len(at)] * len(fours) + four[len(at) :], return_inverse=True, return_counts=True)
    at = at[times[eight] > 1]
    covered = np.zeros(n + 1, np.int64)
    np.add.at(covered, at, 1)
    np.add.at(covered, at + window, -1)
    return int(np.count_nonzero(covered.cumsum()[:n]))


def duplicate_lines(text: bytes) -> int:
    seen, n = set(), 0
    for line in text.split(b"\n"):
        if line in seen:
            n += 1
        elif line.strip():
            seen.add(line)
    return n


_FIRST_BYTE = np.ones(256, bool)
_FIRST_BYTE[0x80:0xC0] = False
_IS_SYMBOL = np.zeros(256, bool)
_IS_SYMBOL[list(SYMBOLS.encode())] = True
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[list(b" \t\n\x0b\x0c\r")] = True


def measures(raw: bytes, ids: np.ndarray) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a text in UTF-8 and its words' numbers."""
    by_byte = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    chars = int(by_byte[_FIRST_BYTE & ~_IS_SPACE].sum())
    return len(ids), chars, int(by_byte[_IS_SYMBOL].sum()), duplicate_lines(raw), repeated_words(ids)


def base_failed(n_words: int, n_repeat: int) -> bool:
    return n_words < MIN_WORDS or 100 * n_repeat > MAX_REPEAT_PERCENT * n_words


def _slot(code: np.ndarray, block: int) -> np.ndarray:
    return ((code * _MIX) >> np.uint64(64 - SLOTS_BITS)).astype(np.int64) + block * SLOTS


def features(raw: bytes, hashes: np.ndarray) -> list[np.ndarray]:
    """Slots of each n-gram of a text, by block; ``hashes`` are its words' hashes."""
    chars = np.frombuffer(raw.decode("utf-8").encode("utf-32-le"), np.uint32).astype(np.uint64)
    two = chars[:-1] << np.uint64(21) | chars[1:]
    three = two[:-1] << np.uint64(21) | chars[2:]
    bigrams = hashes[:-1] * np.uint64(31) + (hashes[1:] << np.uint64(20))
    return [_slot(x + np.uint64(1), i) for i, x in enumerate((hashes, bigrams, two, three))]


@dataclass
class Model:
    weights: np.ndarray  # (BLOCKS * SLOTS), float32
    bias: float
    slope: float  # of the calibration
    offset: float

    @classmethod
    def blank(cls) -> Model:
        """One that knows nothing: every text has a probability of a half."""
        return cls(np.zeros(BLOCKS * SLOTS, np.float32), 0.0, 1.0, 0.0)

    def probability(self, odds: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * odds + self.offset, -40, 40)))

    def log_odds(self, blocks: list[np.ndarray]) -> float:
        return self.bias + float(_FEATURE_SCALE) * sum(float(self.weights[b].mean()) for b in blocks if len(b))


def _solve(slots: np.ndarray, values: np.ndarray, rows: np.ndarray, y: np.ndarray, steps: int = 120, ridge: float = 2e-5) -> tuple[np.ndarray, float]:
    """Logistic regression by Adam on the whole sample, from sparse (row, slot, value) entries."""
    weights, bias = np.zeros(BLOCKS * SLOTS), 0.0
    m, v = np.zeros(BLOCKS * SLOTS + 1), np.zeros(BLOCKS * SLOTS + 1)
    # Both classes weigh the same.
    ones = y.sum()
    weigh = np.where(y > 0, 0.5 / max(ones, 1), 0.5 / max(len(y) - ones, 1))
    for t in range(1, steps + 1):
        odds = np.bincount(rows, values * weights[slots], len(y)) + bias
        error = weigh * (1 / (1 + np.exp(-np.clip(odds, -40, 40))) - y)
        g = np.append(np.bincount(slots, values * error[rows], BLOCKS * SLOTS) + ridge * weights, error.sum())
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        move = 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        weights -= move[:-1]
        bias -= move[-1]
    return weights, bias


def _calibrate(odds: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Platt's slope and offset by Newton steps, with his smoothed targets."""
    if not len(y) or y.min() == y.max():
        return 1.0, 0.0
    ones = y.sum()
    target = np.where(y > 0, (ones + 1) / (ones + 2), 1 / (len(y) - ones + 2))
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * odds + b, -40, 40)))
        w, e = np.maximum(p * (1 - p), 1e-9), p - target
        hessian = np.array([[(w * odds * odds).sum() + 1e-6, (w * odds).sum()], [(w * odds).sum(), w.sum() + 1e-6]])
        step = np.linalg.solve(hessian, [(e * odds).sum(), e.sum()])
        a, b = a - np.clip(step[0], -1, 1), b - np.clip(step[1], -1, 1)
        if np.abs(step).max() < 1e-8:
            break
    return float(a), float(b)


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> Model:
    """A calibrated model from documents and (doc_id, label).

    The sample is bounded by ``max_rows`` and a row by the number of slots, so one task fits it.
    """
    bound_batches(docs.sparkSession)

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words()
        for batch in slices(batches, 64):
            slots, values = [], []
            for text in texts_of(batch):
                raw = text.encode("utf-8", "replace")
                ids = words.ids(raw.split())  # before the hashes are read: new words may move them
                blocks = [b for b in features(raw, words.hashes[ids]) if len(b)]
                found = [np.unique(b, return_counts=True) for b in blocks]
                slots.append(np.concatenate([s for s, _ in found]).astype(np.int32) if found else np.zeros(0, np.int32))
                values.append(np.concatenate([n * _FEATURE_SCALE / n.sum() for _, n in found]).astype(np.float32) if found else np.zeros(0, np.float32))
            columns = [batch.column("doc_id"), pa.array(batch.column("label").to_pylist(), pa.float64())]
            columns += [pa.array(slots, pa.list_(pa.int32())), pa.array(values, pa.list_(pa.float32()))]
            yield pa.record_batch(columns, names=["doc_id", "y", "slots", "values"])

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, y, sizes, slots, values = [], [], [], [], []
        for batch in batches:
            ids += batch.column("doc_id").to_pylist()
            y += batch.column("y").to_pylist()
            sizes.append(batch.column("slots").value_lengths().to_numpy(zero_copy_only=False))
            slots.append(batch.column("slots").flatten().to_numpy())
            values.append(batch.column("values").flatten().to_numpy())
        y, n = np.array(y, float), len(y)
        if not n or y.min() == y.max():  # nothing to tell apart
            prior = float(np.log((y.sum() + 0.5) / (n - y.sum() + 0.5)))
            yield pa.record_batch([pa.array([b""], pa.binary()), pa.array([[prior, 1.0, 0.0]])], names=["weights", "rest"])
            return
        sizes = np.concatenate(sizes)
        rows = np.repeat(np.arange(n), sizes)
        slots, values = np.concatenate(slots), np.concatenate(values)
        aside = np.array([zlib.crc32(str(i).encode()) // 4 % CALIBRATE == 0 for i in ids])
        use = ~aside[rows]
        number = np.cumsum(~aside) - 1
        weights, bias = _solve(slots[use], values[use], number[rows[use]], y[~aside])
        odds = np.bincount(rows, values * weights[slots], n) + bias
        slope, offset = _calibrate(odds[aside], y[aside])
        out = [pa.array([weights.astype("<f4").tobytes()], pa.binary()), pa.array([[bias, slope, offset]])]
        yield pa.record_batch(out, names=["weights", "rest"])

    rows = training_rows(docs, labels, max_rows).mapInArrow(extract, "doc_id long, y double, slots array<int>, values array<float>")
    found = rows.repartition(1).sortWithinPartitions("doc_id", "y").mapInArrow(train, "weights binary, rest array<double>").collect()
    if not found:
        return Model.blank()
    weights = np.frombuffer(found[0]["weights"], "<f4") if found[0]["weights"] else np.zeros(BLOCKS * SLOTS, np.float32)
    return Model(weights, *found[0]["rest"])


def apply_rules(docs: DataFrame, model: Model, keep_from: float = KEEP_FROM, text_col: str = "text") -> DataFrame:
    """``docs`` without the text, with the counts, ``base_failed``, ``probability`` and ``kept``.

    Null counts as empty: no words, so it fails.  A document is kept if it does not fail the base rules and its
    probability reaches ``keep_from``.  Repeated rows are judged alike; other columns pass through, and columns that
    are called as the new ones are replaced.
    """
    bound_batches(docs.sparkSession)
    told = docs.sparkSession.sparkContext.broadcast(model)
    made = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    docs = docs.drop(*made, "base_failed", "probability", "kept")
    names = [c for c in docs.columns if c != text_col]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name != text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, words = told.value, Words()
        for batch in slices(batches):
            rows, odds = [], []
            for text in texts_of(batch, text_col):
                if words.bytes > _INTERN_BYTES:
                    words = Words()
                raw = text.encode("utf-8", "replace")
                ids = words.ids(raw.split())
                rows.append(measures(raw, ids))
                odds.append(model.log_odds(features(raw, words.hashes[ids])))
            p = model.probability(np.array(odds))
            failed = np.array([base_failed(r[0], r[4]) for r in rows])
            counts = [pa.array(c, pa.int64()) for c in zip(*rows, strict=True)]
            more = [pa.array(failed), pa.array(p), pa.array(~failed & (p >= keep_from))]
            yield pa.record_batch([*[batch.column(c) for c in names], *counts, *more], names=[*names, *made, "base_failed", "probability", "kept"])

    return docs.mapInArrow(run, f"{schema}, {', '.join(f'{c} long' for c in made)}, base_failed boolean, probability double, kept boolean")


def judge(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> DataFrame:
    """Fits on labelled rows outside the held-out quarter (crc32 of the id leaves 2 modulo 4) and judges all.

    Null texts are empty and fail; whole texts are read; a probability of exactly KEEP_FROM keeps.  Without labels of both
    kinds every text has the prior's probability.  An empty table gives an empty result.
    """
    held_out = F.coalesce(F.pmod(id_hash(F.col("doc_id")), F.lit(4)) == 2, F.lit(False))
    known = labels.where(~held_out).select("doc_id", F.col("quality").cast("double").alias("label"))
    return apply_rules(docs.select("doc_id", "text"), fit(docs, known, max_rows))
