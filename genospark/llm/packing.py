"""Best-fit packing by length patterns: non-negative least squares over the histogram of lengths.

Only lengths are packed.  The histogram has at most ``capacity`` entries whatever the corpus, so the fit runs on the
driver; documents then find their places by rank within their length, which is taken in salted groups.
"""

from __future__ import annotations

import logging
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bound_batches, shuffle_width, slices, stored
from .tokens import PieceTokenizer

CAPACITY = 1024
END_ID = 2
#: Ids that the patterns of each round of the fit may leave empty.
SLACKS = (0, 1, 4, 16, 64)
#: The fit ends when no unused pattern agrees with what is missing by more than so many documents.
FIT_TOLERANCE, FIT_AT_ONCE = 1e-3, 64
#: Shares of the fitted patterns, the least certain ones, that are tried for a joint best fit with the residual.
DISSOLVE = (0.0, 0.05, 0.1, 0.2, 0.4, 0.7, 1.0)
log = logging.getLogger(__name__)
#: Bytes of pieces that a worker remembers, and of text that it takes at a time.  Two workers share an executor's memory with a
#: JVM that grows to its full heap, so both are kept small.
REMEMBERED, SLICE = 64 << 20, 4 << 20
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def enumerate_patterns(lengths: np.ndarray, capacity: int, slack: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Patterns of few documents that leave at most ``slack`` ids empty: their lengths and how often each occurs.

    Both arrays have three columns, 0 standing for none.  Patterns are up to three of the given lengths, or several
    documents of one length and one more.
    """
    there = np.zeros(capacity + 1, bool)
    there[lengths] = True
    size, times = [], []

    def add(*columns: tuple[np.ndarray | int, np.ndarray | int]) -> None:
        n = max(np.size(x) for pair in columns for x in pair)
        full = [[np.broadcast_to(x, n) for x in pair] for pair in columns] + [[np.zeros(n, int)] * 2] * (3 - len(columns))
        size.append(np.stack([x[0] for x in full], 1))
        times.append(np.stack([x[1] for x in full], 1))

    for fill in range(capacity, capacity - slack - 1, -1):
        if fill > 0 and there[fill]:
            add((fill, 1))
        for a in np.flatnonzero(there[: max(fill, 0)]).tolist():
            rest = fill - a
            if rest < a and there[rest]:
                add((a, 1), (rest, 1))
            # Three different lengths a > b > c.
            b = np.arange(rest // 2 + 1, min(a, rest))
            b = b[there[b] & there[rest - b]]
            if len(b):
                add((a, 1), (b, 1), (rest - b, 1))
            # Several of one length, alone or with one of another.
            k = np.arange(2, fill // a + 1)
            more = fill - k * a
            if len(k) and more[-1] == 0:
                add((a, int(k[-1])))
            k, more = k[(more > 0) & (more != a)], more[(more > 0) & (more != a)]
            k, more = k[there[more]], more[there[more]]
            if len(k):
                add((a, k), (more, 1))
    if not size:
        return np.zeros((0, 3), int), np.zeros((0, 3), int)
    return np.concatenate(size), np.concatenate(times)


def fit_counts(size: np.ndarray, times: np.ndarray, histogram: np.ndarray, tolerance: float = FIT_TOLERANCE) -> tuple[np.ndarray, np.ndarray, float]:
    """Non-negative least squares: x >= 0 that minimises |A x - histogram|, A counting each length in each pattern.

    Returns the patterns with x > 0, their x, and the largest violation left of the optimality conditions: by how
    many documents any unused pattern still agrees with what is missing.  An active-set method: the patterns that
    agree most, no two with a length in common, become free together; the least squares over the free ones is solved
    and patterns whose count would be negative are taken out again.  So few patterns are used, which rounds well.
    """
    h = histogram.astype(float)
    h[0] = 0
    free, x = np.zeros(0, int), np.zeros(0)
    columns, gram = np.zeros((len(h), 0)), np.zeros((0, 0))
    is_free = np.zeros(len(size), bool)
    rest, at_once = h.copy(), FIT_AT_ONCE
    while True:
        agree = (rest[size] * times).sum(1) / np.sqrt((times * times).sum(1))
        agree[is_free] = -np.inf
        worst = float(agree.max(initial=0.0))
        if worst <= tolerance:
            break
        used, new = np.zeros(len(h), bool), []
        for j in np.argsort(-agree, kind="stable")[: 16 * at_once]:
            if agree[j] <= tolerance or len(new) == at_once:
                break
            if not used[size[j]].any():
                used[size[j][times[j] > 0]] = True
                new.append(j)
        added = np.zeros((len(h), len(new)))
        for c in range(3):
            added[size[new, c], np.arange(len(new))] += times[new, c]
        added[0] = 0
        cross = columns.T @ added
        gram = np.block([[gram, cross], [cross.T, added.T @ added]])
        columns, free, x = np.concatenate([columns, added], 1), np.append(free, new), np.append(x, np.zeros(len(new)))
        is_free[new] = True
        while True:
            # A trace of ridge keeps dependent patterns solvable.
            z = np.linalg.solve(gram + 1e-9 * np.eye(len(free)), columns.T @ h)
            low = z <= 0
            if not low.any():
                x = z
                break
            x = x + min(1.0, (x[low] / (x[low] - z[low])).min()) * (z - x)
            keep = ~(low & (x <= 1e-9))
            is_free[free[~keep]] = False
            free, x, columns, gram = free[keep], x[keep], columns[:, keep], gram[np.ix_(keep, keep)]
        before, rest = rest @ rest, h - columns @ x
        if rest @ rest >= before - 1e-9:  # no progress: fewer at a time, in the end one, which always makes some
            if at_once == 1:
                break
            at_once = max(1, at_once // 8)
    return free, x, worst


def pack_residuals(left: np.ndarray, capacity: int) -> list[tuple[list[int], int]]:
    """Best fit, longest first, over counts of lengths: (pattern, repeats).  Equal bins are one entry."""
    bins: dict[int, list[tuple[list[int], int]]] = defaultdict(list)
    for size in range(capacity, 0, -1):
        n = int(left[size])
        free = size
        while n > 0:
            while free <= capacity and not bins.get(free):
                free += 1
            if free > capacity:
                each = capacity // size
                if n // each:
                    bins[capacity - each * size].append(([size] * each, n // each))
                if n % each:
                    bins[capacity - n % each * size].append(([size] * (n % each), 1))
                break
            pattern, repeats = bins[free].pop()
            each = free // size
            full = min(repeats, n // each)
            if full:
                bins[free - each * size].append((pattern + [size] * each, full))
                n -= full * each
                repeats -= full
            if repeats and n:  # fewer than a whole bin takes
                bins[free - n * size].append((pattern + [size] * n, 1))
                n, repeats = 0, repeats - 1
            if repeats:
                bins[free].append((pattern, repeats))
    return [entry for group in bins.values() for entry in group]


def plan(histogram: np.ndarray, capacity: int) -> list[tuple[list[int], int]]:
    """Patterns and repeats that hold every length as often as the histogram has it.

    Full patterns are fitted and rounded first; what rounding leaves is fitted again with patterns of ever more slack.
    The residual is packed by best fit, together with the least certain patterns where that saves sequences.
    """
    left = histogram.astype(np.int64).copy()
    fitted: list[tuple[float, list[int], int]] = []
    for slack in SLACKS:
        size, times = enumerate_patterns(np.flatnonzero(left[1:]) + 1, capacity, slack)
        if not len(size):
            continue
        free, counts, violation = fit_counts(size, times, left)
        before = int(left.sum())
        for at in np.argsort(-counts, kind="stable"):
            there = times[free[at]] > 0
            own, each = size[free[at]][there], times[free[at]][there]
            want = min(int(counts[at] + 0.5), int((left[own] // each).min()))  # never more than there is
            if want:
                left[own] -= want * each
                fitted.append((abs(counts[at] - want) / want, np.repeat(own, each).tolist(), want))
        log.info("slack %d: %d patterns, %d used, violation %.1e, %d of %d pieces placed", slack, len(size), len(free), violation, before - left.sum(), before)
    fitted.sort(key=lambda f: f[0])
    least = -(-int((histogram * np.arange(capacity + 1)).sum()) // capacity)
    best: list[tuple[list[int], int]] | None = None
    for share in DISSOLVE:
        kept = fitted[: len(fitted) - int(share * len(fitted))]
        pool = left.copy()
        for _, pattern, repeats in fitted[len(kept) :]:
            np.add.at(pool, pattern, repeats)
        found = [(pattern, repeats) for _, pattern, repeats in kept] + pack_residuals(pool, capacity)
        if best is None or sum(n for _, n in found) < sum(n for _, n in best):
            best = found
        if sum(n for _, n in best) <= least:
            break
    return best


def places(blocks: list[tuple[list[int], int]]) -> dict[str, np.ndarray]:
    """Arrays by (length, first rank): the first sequence and the offset of the run of ranks that starts there."""
    base, next_rank, rows = 0, defaultdict(int), []
    for pattern, repeats in blocks:
        offset = 0
        for size in pattern:
            rows.append((size, next_rank[size], base, offset))
            next_rank[size] += repeats
            offset += size
        base += repeats
    table = np.array(sorted(rows), np.int64).reshape(-1, 4)
    return {"length": table[:, 0], "rank": table[:, 1], "sequence": table[:, 2], "offset": table[:, 3]}


def token_pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """Rows (doc_id, piece, start, length, ids_crc32).  Null text is empty and has the end id alone."""
    spec = docs.sparkSession.sparkContext.broadcast(open(tokenizer_path).read())

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = PieceTokenizer.get(spec.value, REMEMBERED)
        for batch in slices(batches, 1 << 14, SLICE):
            ids, bounds = tokenizer.encode(batch.column("text"), end_id)
            raw = ids.astype("<u4", copy=False).data.cast("B")
            n = np.diff(bounds)
            # The first piece takes the remainder; each later one is full.
            pieces = -(-n // capacity)
            first = n - (pieces - 1) * capacity
            doc = np.repeat(np.arange(len(n)), pieces)
            piece = np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            start = np.where(piece > 0, first[doc] + (piece - 1) * capacity, 0)
            length = np.where(piece > 0, capacity, first[doc])
            at = 4 * (bounds[doc] + start)
            crc = [zlib.crc32(raw[a:b]) for a, b in zip(at.tolist(), (at + 4 * length).tolist(), strict=True)]
            columns = [batch.column("doc_id").take(pa.array(doc)), pa.array(piece, pa.int32()), pa.array(start), pa.array(length), pa.array(crc, pa.int64())]
            yield pa.record_batch(columns, names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.mapInArrow(cut, PIECES)


def pack(
    docs: DataFrame,
    tokenizer_path: str,
    capacity: int = CAPACITY,
    end_id: int = END_ID,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Packs documents into sequences of at most ``capacity`` ids: a row per piece with its sequence and offset.

    A document longer than the capacity is cut; its first piece takes the remainder.  Other documents stay whole.
    Null and empty texts are documents of the end id alone.  Repeated rows are packed as often as they occur; ties
    of rank fall to the id, the piece and the checksum.  An empty table gives an empty result.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    # Salted by hash: as many groups to a length as there are shuffle partitions, however common the length is.
    salt = F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(shuffle_width(spark))).alias("salt")
    pieces = stored(token_pieces(narrow, tokenizer_path, capacity, end_id).select("*", salt), "pack-pieces")
    histogram = np.zeros(capacity + 1, np.int64)
    for row in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect():  # at most `capacity` rows
        histogram[row["length"]] = row["n"]
    found = spark.sparkContext.broadcast(places(plan(histogram, capacity)))

    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    # Counted once more in the plan of the result: to store these few rows takes a file for each task of the shuffle.
    groups = pieces.groupBy("length", "salt").agg(F.count(F.lit(1)).alias("n"))
    offsets = groups.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    order = Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32")
    ranked = (
        pieces.withColumn("row", F.row_number().over(order))
        .join(offsets, ["length", "salt"])
        .select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("row") - 1).alias("rank"))
    )

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = found.value
        keys = (table["length"] << 44) | table["rank"]
        for batch in batches:
            length, rank = (batch.column(c).to_numpy() for c in ("length", "rank"))
            at = np.searchsorted(keys, (length << 44) | rank, "right") - 1
            sequence = table["sequence"][at] + rank - table["rank"][at]
            kept = [batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")]
            yield pa.record_batch(
                [*kept, pa.array(sequence), pa.array(table["offset"][at])],
                names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
            )

    return ranked.mapInArrow(place, PIECES + ", sequence_id long, offset long")
