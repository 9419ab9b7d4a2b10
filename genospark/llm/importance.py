"""Target-distribution importance resampling: documents are drawn by how much likelier a target makes their n-grams.

Features are hashed n-grams.  A bucket's gain is the scaled, rounded logarithm of its frequency in the target over that
in the documents, and a document's weight is the sum of its features' gains.  That sum is taken by bits: a document's
bucket counts become planes of one bit a bucket, the gains become planes of their magnitudes' bits by sign, and the
population count of two planes' AND, times the power of two that the planes stand for, adds up to the exact weight.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.ranks import numbered
from .common import bound_batches, slices, stored

BUCKETS, LONGEST = 10_000, 3
LEAST_WORDS, PERCENT, SEED = 20, 5, 42
#: Bytes of a text that are cut into words at a time, and bytes of known words before a worker starts anew.
_PIECE, _KNOWN_BYTES, _ENTRY = 1 << 20, 64 << 20, 200
#: Words up to so many bytes extend a checksum by a table look-up.
_SHORT = 63
#: Documents whose counts meet in planes at a time.
_DOCS = 64


def _word_bytes() -> bytes:
    """Byte -> itself in lower case, or a blank if no word has it; bytes from 128 belong to words."""
    keep = set(b"0123456789abcdefghijklmnopqrstuvwxyz") | set(range(128, 256))
    return bytes(b + 32 if 65 <= b <= 90 else b if b in keep else 32 for b in range(256))


def _shifts() -> np.ndarray:
    """[length, byte's place, byte] -> what ``length`` zero bytes make of a crc32 with that byte at that place."""
    step = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        step = np.where(step & 1, step >> 1 ^ np.uint32(0xEDB88320), step >> 1).astype(np.uint32)
    out = np.zeros((_SHORT + 2, 4, 256), np.uint32)
    out[0] = np.arange(256, dtype=np.uint32) << (8 * np.arange(4, dtype=np.uint32))[:, None]
    for n in range(1, len(out)):
        out[n] = out[n - 1] >> 8 ^ step[out[n - 1] & 255]
    return out


_WORD_BYTES, _SHIFTS = _word_bytes(), _shifts().reshape(-1)


class Words(dict):
    """Word -> number in order of appearance; by number the crc32 of the word and of a blank and the word, and the size."""

    def __init__(self):
        super().__init__()
        self.known: list[bytes] = []
        self.alone, self.after, self.size, self.bytes = *(np.zeros(1 << 14, np.uint32) for _ in range(2)), np.zeros(1 << 14, np.int64), 0

    def __missing__(self, word: bytes) -> int:
        at = self[word] = len(self)
        if at >= len(self.alone):
            self.alone, self.after, self.size = (np.concatenate([x, np.zeros_like(x)]) for x in (self.alone, self.after, self.size))
        self.alone[at], self.after[at], self.size[at] = zlib.crc32(word), zlib.crc32(b" " + word), len(word) + 1
        self.known.append(word)
        self.bytes += len(word) + _ENTRY
        return at

    def numbers(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.int64, len(words))

    def extended(self, codes: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """crc32 of sequences with checksums ``codes`` that go on with a blank and the words ``ids``."""
        size = self.size[ids]
        base = np.minimum(size, _SHORT + 1) * 1024
        out = self.after[ids]
        for place in range(4):
            out = out ^ _SHIFTS[base + 256 * place + (codes >> np.uint32(8 * place) & np.uint32(255))]
        for at in np.flatnonzero(size > _SHORT + 1):
            out[at] = zlib.crc32(b" " + self.known[ids[at]], int(codes[at]))
        return out


def pieces(raw: bytes, most: int = _PIECE) -> Iterator[list[bytes]]:
    """The words of a text, piece by piece; no word is cut."""
    at = 0
    while at < len(raw):
        end = at + most
        while end < len(raw):  # on to a byte that is in no word
            blank = raw[end : end + 4096].translate(_WORD_BYTES).find(b" ")
            end += 4096 if blank < 0 else blank
            if blank >= 0:
                break
        yield raw[at:end].translate(_WORD_BYTES).split()
        at = end


def buckets(words: Words, ids: np.ndarray, owner: np.ndarray, n_buckets: int, carried: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(owner, bucket) of the n-grams of consecutive words of one owner, without those that end in the first ``carried``."""
    codes = words.alone[ids]
    owners, found = [owner[carried:]], [codes[carried:]]
    for n in range(1, LONGEST):
        if len(ids) <= n:
            break
        codes = words.extended(codes[:-1], ids[n:])
        own = owner[: len(codes)] == owner[n:]
        own[: max(carried - n, 0)] = False
        owners.append(owner[n:][own])
        found.append(codes[own])
    return np.concatenate(owners), (np.concatenate(found) % np.uint32(n_buckets)).astype(np.int64)


def _counted(batch: pa.RecordBatch, words: Words, n_buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Counts by document and bucket, and numbers of words, of a batch's texts."""
    texts = [t or b"" for t in batch.column("text").cast(pa.binary()).to_pylist()]
    counts, n_words = np.zeros((len(texts), n_buckets), np.int64), np.zeros(len(texts), np.int64)
    short, owners = [], []
    for at, raw in enumerate(texts):
        if len(raw) <= _PIECE:
            found = raw.translate(_WORD_BYTES).split()
            n_words[at] = len(found)
            short += found
            owners.append(np.full(len(found), at))
            continue
        carry = np.zeros(0, np.int64)
        for found in pieces(raw):
            ids = np.concatenate([carry, words.numbers(found)])
            _, bucket = buckets(words, ids, np.zeros(len(ids), np.int64), n_buckets, len(carry))
            counts[at] += np.bincount(bucket, minlength=n_buckets)
            n_words[at] += len(found)
            carry = ids[len(ids) - min(LONGEST - 1, len(ids)) :]
    ids = words.numbers(short)
    owner, bucket = buckets(words, ids, np.concatenate(owners) if owners else np.zeros(0, np.int64), n_buckets)
    counts += np.bincount(owner * n_buckets + bucket, minlength=counts.size).reshape(counts.shape)
    return counts, n_words


def feature_counts(docs: DataFrame, n_buckets: int = BUCKETS) -> np.ndarray:
    """How often each bucket occurs in all texts; a row a bucket reaches the driver."""
    bound_batches(docs.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, total = Words(), np.zeros(n_buckets, np.int64)
        for batch in slices(batches, _DOCS):
            if words.bytes > _KNOWN_BYTES:
                words = Words()
            total += _counted(batch, words, n_buckets)[0].sum(0)
        yield pa.record_batch([pa.array(np.arange(n_buckets), pa.int32()), pa.array(total)], names=["bucket", "n"])

    sums = docs.select("text").mapInArrow(count, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(n_buckets, np.int64)
    for r in sums.collect():
        out[r["bucket"]] = r["n"]
    return out


def gains(own: np.ndarray, target: np.ndarray) -> np.ndarray:
    """A bucket's gain: the floor of 1000 times the log ratio of its smoothed frequencies in the target and here."""
    wide, k = float(own.sum() + len(own)), float(target.sum() + len(own))
    ratio = [(float(t) + 1) * wide / ((float(s) + 1) * k) for s, t in zip(own.tolist(), target.tolist(), strict=True)]
    return np.array([math.floor(1000 * math.log(r)) for r in ratio], np.int64)


def planes(values: np.ndarray) -> list[np.ndarray]:
    """The bits of rows of non-negative numbers, from the lowest: packed rows in 64-bit words."""
    width = -(-values.shape[1] // 64) * 8
    out = []
    for bit in range(int(values.max(initial=0)).bit_length()):
        packed = np.packbits((values >> bit & 1).astype(np.uint8), axis=1)
        out.append(np.pad(packed, ((0, 0), (0, width - packed.shape[1]))).view(np.uint64))
    return out


def gain_planes(gain: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Planes of the gains' magnitudes, those of gains above 0 and of those below, and the signed power of two of each."""
    up, down = planes(np.maximum(gain, 0)[None]), planes(np.maximum(-gain, 0)[None])
    rows = [p[0] for p in (*up, *down)]
    power = [1 << i for i in range(len(up))] + [-(1 << i) for i in range(len(down))]
    return np.array(rows, np.uint64), np.array(power, np.int64)


def weights(counts: np.ndarray, rows: np.ndarray, power: np.ndarray) -> np.ndarray:
    """The sum of gains over each document's features, from its counts and the gains' planes."""
    out = np.zeros(len(counts), np.int64)
    if not len(rows):
        return out
    for bit, plane in enumerate(planes(counts)):
        some = np.flatnonzero(plane.any(axis=1))
        common = np.bitwise_count(plane[some][:, None, :] & rows[None]).sum(2, dtype=np.int64)
        out[some] += (common @ power) << bit
    return out


def weigh(docs: DataFrame, gain: np.ndarray) -> DataFrame:
    """``docs`` without the text, with ``n_words``, ``n_features`` and ``weight``; null texts are empty, which weigh 0."""
    bound_batches(docs.sparkSession)
    docs = docs.drop("n_words", "n_features", "weight")
    told = docs.sparkSession.sparkContext.broadcast((*gain_planes(gain), len(gain)))
    names = [c for c in docs.columns if c != "text"]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name != "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, (rows, power, n_buckets) = Words(), told.value
        for batch in slices(batches, _DOCS):
            if words.bytes > _KNOWN_BYTES:
                words = Words()
            counts, n_words = _counted(batch, words, n_buckets)
            made = [pa.array(x) for x in (n_words, counts.sum(1), weights(counts, rows, power))]
            yield pa.record_batch([*[batch.column(c) for c in names], *made], names=[*names, "n_words", "n_features", "weight"])

    return docs.mapInArrow(run, f"{schema}, n_words long, n_features long, weight long")


def noise(id_col: str, seed: int) -> Column:
    """The scaled Gumbel noise of an id, from its hash: adding it to scaled log weights and taking the largest draws
    without replacement."""
    digits = F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.col(id_col).cast("string")).cast("binary"), 256), 1, 8)
    h = F.conv(digits, 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / 4294967296.0)))


def resample(
    docs: DataFrame, target: DataFrame, id_col: str = "doc_id", n_buckets: int = BUCKETS, least_words: int = LEAST_WORDS,
    percent: int = PERCENT, seed: int = SEED,
) -> DataFrame:
    """``docs`` without the text, with n_words, n_features, weight, score and ``rank``: 1, 2, ... for those drawn.

    Of the documents with ``least_words`` words or more, ``percent`` percent (rounded down) with the highest scores are
    drawn, ties going to the smaller id, then to fewer features.  Whole texts are read, however long; null or wordless ones
    have no features and weigh 0.  A row without an id has no score and is no candidate.  Rows that repeat an id are
    candidates each.  Columns called as the new ones are replaced.  An empty table gives no rows, an empty target equal odds.
    """
    docs = docs.drop("score", "rank")
    gain = gains(feature_counts(docs, n_buckets), feature_counts(target, n_buckets))
    weighed = weigh(docs, gain).withColumn("score", F.col("weight") + noise(id_col, seed))
    weighed = stored(weighed, "importance-weights")
    able = (F.col("n_words") >= least_words) & F.col(id_col).isNotNull()
    candidates = weighed.where(able)
    drawn = candidates.count() * percent // 100
    ranked = numbered(candidates, "rank", -F.col("score"), id_col, "n_features")
    ranked = ranked.withColumn("rank", F.when(F.col("rank") < drawn, F.col("rank") + 1))
    return ranked.unionByName(weighed.where(~able).withColumn("rank", F.lit(None).cast("long")))
