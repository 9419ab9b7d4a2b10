"""Admixture proportions by multiplicative matrix factorisation: calls ~ Q H, rows of Q adding up to 1."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import discard, stored
from .calls import cells, column_statistics, individual_index, marker_index
from .linalg import MAX_BROADCAST, add_blocks, bound_batches, sparse_parts

FLOOR = 1e-9
#: Iterations between writes of Q to the shared folder.
STORE_EVERY = 10
#: Bytes of all tasks' sums that the driver may add up itself, which spares a stage an iteration.
FEW_BYTES = 16 << 20
#: Bytes of the H that wait for the next write of Q, and columns of a block of sums.
PENDING_BYTES, _COLUMNS = 64 << 20, 2048


def start_value(i: np.ndarray, j: np.ndarray, seed: int) -> np.ndarray:
    """The reproducible start: a number in (0, 1] for row i and column j."""
    return ((i * 7919 + j * 104729 + seed * 31) % 10007) / 10007.0 + 1e-3


def _matrix(calls: DataFrame) -> tuple[DataFrame, DataFrame, np.ndarray]:
    """Sparse rows (row_idx, idx, v), markers with their index, and the means that fill missing cells.

    ``v`` is a call less its marker's mean, so the matrix is a row of means, the same for all, plus sparse rows.
    """
    people = individual_index(calls)
    markers = stored(column_statistics(calls).select("marker", "mean").join(marker_index(calls), "marker"), "admixture-markers")
    entries = cells(calls).where("dosage is not null").join(markers, "marker").groupBy("individual").agg(
        F.collect_list(F.struct(F.col("marker_idx").cast("int").alias("i"), (F.col("dosage") - F.col("mean")).alias("v"))).alias("e")
    )
    empty = F.array()
    rows = people.join(entries, "individual", "left").select(
        "individual", F.col("row_idx").cast("long").alias("row_idx"), F.coalesce("e.i", empty.cast("array<int>")).alias("idx"), F.coalesce("e.v", empty.cast("array<double>")).alias("v")
    )
    found = markers.select("marker_idx", "mean").toArrow()
    fill = np.zeros(found.num_rows)
    fill[found["marker_idx"].to_numpy()] = found["mean"].to_numpy()
    return rows, markers, fill


def times_h(idx: np.ndarray, v: np.ndarray, row: np.ndarray, n: int, h: np.ndarray, fill: np.ndarray) -> np.ndarray:
    """X H' of n rows: the means' part is one row."""
    return (h @ fill)[None] + np.stack([np.bincount(row, v * part[idx], n) for part in h], 1)


def update_q(q: np.ndarray, xh: np.ndarray, h: np.ndarray) -> np.ndarray:
    q = np.maximum(FLOOR, q * xh / np.maximum(q @ (h @ h.T), FLOOR))
    return q / q.sum(1, keepdims=True)


def update_h(h: np.ndarray, qtx: np.ndarray, qtq: np.ndarray) -> np.ndarray:
    return np.maximum(FLOOR, h * qtx / np.maximum(qtq @ h, FLOOR))


def squared_error(idx: np.ndarray, v: np.ndarray, row: np.ndarray, q: np.ndarray, h: np.ndarray, fill: np.ndarray) -> float:
    """|X - Q H|^2: that of the means against Q H, by products of k, and what the observed cells add to it."""
    means = len(q) * (fill @ fill) - 2 * (q @ (h @ fill)).sum() + ((q @ (h @ h.T)) * q).sum()
    gap = fill[idx] - sum(q[row, c] * part[idx] for c, part in enumerate(h))
    return float(means + (v * (v + 2 * gap)).sum())


def _q_of(part: pa.RecordBatch, k: int) -> np.ndarray:
    return part.column("q").flatten().to_numpy().reshape(-1, k)


def _pass(rows: DataFrame, hs: list[np.ndarray], fill: np.ndarray, k: int, few: bool) -> tuple[np.ndarray, np.ndarray, float]:
    """Q'X, Q'Q and the squared error under the last of ``hs``, for Q brought up to date by all of them.

    Each task adds up its rows and sends its sums in blocks of columns; Spark adds up each block, or the driver all if
    they are ``few``.
    """
    told = rows.sparkSession.sparkContext.broadcast((hs, fill))
    m = len(fill)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hs, fill = told.value
        qtx, qtq, ones, error = np.zeros((k, m)), np.zeros((k, k)), np.zeros(k), 0.0
        for part, idx, v, row in sparse_parts(batches):
            q = _q_of(part, k)
            for h in hs:
                q = update_q(q, times_h(idx, v, row, len(q), h, fill), h)
            if hs:
                error += squared_error(idx, v, row, q, hs[-1], fill)
            for c in range(k):
                qtx[c] += np.bincount(idx, v * q[row, c], m)
            qtq += q.T @ q
            ones += q.sum(0)
        small = np.concatenate([qtq.reshape(-1), ones, [error]])
        for block, flat in enumerate([small, *(qtx[:, at : at + _COLUMNS].reshape(-1) for at in range(0, m, _COLUMNS))]):
            yield pa.record_batch([pa.array([0], pa.int32()), pa.array([block], pa.int32()), pa.array([flat], pa.list_(pa.float64()))], names=["key", "block", "v"])

    sums = rows.mapInArrow(partial, "key int, block int, v array<double>")
    found = (sums if few else add_blocks(sums)).toArrow()
    total: dict[int, np.ndarray] = {}
    for block, flat in zip(found["block"].to_pylist(), found["v"], strict=True):
        value = flat.values.to_numpy()
        total[block] = total[block] + value if block in total else value
    small, ones = total[0], total[0][k * k : k * k + k]
    qtx = np.concatenate([total[b].reshape(k, -1) for b in range(1, len(total))], 1) + np.outer(ones, fill)
    return qtx, small[: k * k].reshape(k, k), float(small[-1])


def _advance(rows: DataFrame, hs: list[np.ndarray], fill: np.ndarray, k: int) -> DataFrame:
    told = rows.sparkSession.sparkContext.broadcast((hs, fill))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hs, fill = told.value
        for part, idx, v, row in sparse_parts(batches):
            q = _q_of(part, k)
            for h in hs:
                q = update_q(q, times_h(idx, v, row, len(q), h, fill), h)
            at = part.schema.get_field_index("q")
            yield part.set_column(at, "q", pa.array(list(q), pa.list_(pa.float64())))

    return rows.mapInArrow(run, rows.schema)


def fit_admixture(
    calls: DataFrame, n_populations: int, max_iter: int = 500, tol: float = 1e-4, seed: int = 0, start: tuple[np.ndarray, np.ndarray] | None = None
) -> tuple[DataFrame, DataFrame, list[float]]:
    """``q(individual, q)``, ``p(marker, p)`` and the squared error by iteration.

    Each iteration updates H, then Q with the new H, normalises Q's rows and measures the error; it ends when the
    error moves by less than ``tol``.  ``start`` (Q by row_idx, H) replaces the hashed start.  The driver and each task hold
    H, k numbers a marker, which must fit ``linalg.MAX_BROADCAST``; no task holds a dense row of calls.
    """
    if n_populations < 1:
        raise ValueError("n_populations must be at least 1")
    k = n_populations
    rows, markers, fill = _matrix(calls)
    m = len(fill)
    if not m:
        raise ValueError("there are no calls")
    if 8 * k * m > MAX_BROADCAST:
        raise ValueError(f"{k} populations of {m} markers are over {MAX_BROADCAST} bytes")
    bound_batches(calls.sparkSession)
    most = max(1, min(STORE_EVERY, PENDING_BYTES // (8 * k * m)))
    if start is None:
        # row_idx * 7919 etc. on the executors; each row normalised
        u = [F.expr(f"((row_idx * 7919L + {j} * 104729L + {seed} * 31L) % 10007) / 10007.0D + 1e-3D") for j in range(k)]
        total = sum(u[1:], u[0])
        rows = rows.withColumn("q", F.array(*[x / total for x in u]))
        i, j = np.meshgrid(np.arange(m), np.arange(k))
        h = start_value(i, j, seed + 1)
    else:
        q0 = rows.sparkSession.createDataFrame([(n, list(map(float, v))) for n, v in enumerate(start[0])], "row_idx long, q array<double>")
        rows, h = rows.join(q0, "row_idx"), start[1]
    rows = stored(rows, "admixture-rows")
    tasks = rows.select(F.spark_partition_id().alias("t")).distinct().count()
    few = 8 * k * (m + k) * tasks <= FEW_BYTES
    errors: list[float] = []
    pending: list[np.ndarray] = []
    qtx, qtq, _ = _pass(rows, pending, fill, k, few)
    for _ in range(max_iter):
        h = update_h(h, qtx, qtq)
        pending.append(h)
        qtx, qtq, error = _pass(rows, pending, fill, k, few)
        errors.append(error)
        if len(errors) > 1 and abs(errors[-2] - error) < tol:
            break
        if len(pending) == most:
            old, rows, pending = rows, stored(_advance(rows, pending, fill, k), "admixture-rows"), []
            discard(old)
    q = _advance(rows, pending, fill, k).select("individual", "q")
    p = rows.sparkSession.createDataFrame(pa.table({"marker_idx": pa.array(np.arange(m)), "p": pa.array(list(h.T), pa.list_(pa.float64()))}))
    return q, markers.join(p, "marker_idx").select("marker", "p"), errors


def transform(calls: DataFrame, p: DataFrame, k: int) -> DataFrame:
    """(individual, q): one multiplicative step from ones, then normalised; markers are matched by name.

    A missing call is the mean of these calls; a marker without calls counts as 0.
    """
    means = column_statistics(calls).select("marker", "mean")
    model = stored(p.join(means, "marker", "left").select("marker", "p", F.coalesce("mean", F.lit(0.0)).alias("mean")), "admixture-model")
    # x . p = (means . p) + sum over observed calls of (dosage - mean) p: the grid is not built.
    base = model.agg(F.struct(*[F.sum(F.col("mean") * F.col("p")[c]).alias(f"b{c}") for c in range(k)]).alias("b")).scalar()
    gram = model.agg(F.struct(*[F.sum(F.col("p")[c] * sum([F.col("p")[e] for e in range(1, k)], F.col("p")[0])).alias(f"d{c}") for c in range(k)]).alias("d")).scalar()
    moved = calls.where("dosage is not null").join(model, "marker").groupBy("individual").agg(
        *[F.sum((F.col("dosage") - F.col("mean")) * F.col("p")[c]).alias(f"s{c}") for c in range(k)]
    )
    all_rows = calls.select("individual").distinct().join(moved, "individual", "left").withColumn("b", base).withColumn("d", gram)
    raw = [F.greatest(F.lit(FLOOR), (F.col(f"b.b{c}") + F.coalesce(f"s{c}", F.lit(0.0))) / F.greatest(F.col(f"d.d{c}"), F.lit(FLOOR))) for c in range(k)]
    total = sum(raw[1:], raw[0])
    return all_rows.select("individual", F.array(*[r / total for r in raw]).alias("q"))
