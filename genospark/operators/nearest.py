"""Nearest clusters and trees from a matrix of individuals, without a table of their pairs.

The matrix (a row an individual) is broadcast, so its bytes are checked; tasks multiply their own rows with all of it, block
by block, and return the nearest clusters of each cluster that was asked for.  The driver keeps these lists, some numbers an
individual.  A list has the K nearest and a bound: no cluster outside it is nearer than that.  A merge never brings a cluster
nearer to others than the nearer of its parts was, so lists are carried over merges and asked for again only when the bound
no longer tells which cluster is the nearest.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import discard, stored
from .linalg import bound_batches, sparse_rows

#: Bytes of a matrix that is broadcast (pairs of wider ones come from ``linalg.pair_blocks``), and of rows that are fetched at once.
MATRIX_BYTES, _PART = 256 << 20, 32 << 20
#: Clusters whose last merges are one task's, by a matrix of 128 MB at most.
LAST = 4096
#: Nearest clusters in a list; rows that are multiplied at once, and rows a task; the share of clusters of unknown nearest
#: that is asked for.
K, _ROWS, _SHARE, _UNKNOWN = 32, 256, 1024, 0.2
#: Squared distances under this share of the squared lengths are taken by differences.
_SMALL = 1e-4


def rows_of(entries: DataFrame, n: int, m: int) -> np.ndarray:
    """The matrix of entries (i, j, v), absent ones being 0, by sparse rows, some _PART bytes of them at a time."""
    bound_batches(entries.sparkSession)
    out = np.zeros((n, m))
    rows, step = stored(sparse_rows(entries, "i", "j", "v", key="i").select("key", "idx", "v"), "nearest-rows"), max(1, _PART // (8 * max(m, 1)))
    for first in range(0, n, step):
        for batch in rows.where((F.col("key") >= first) & (F.col("key") < first + step)).toArrow().to_batches():
            size = batch.column("idx").value_lengths().to_numpy(zero_copy_only=False)
            out[np.repeat(batch.column("key").to_numpy(), size), batch.column("idx").flatten().to_numpy()] = batch.column("v").flatten().to_numpy()
    discard(rows)
    return out


def squares(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Squared distances of rows, by products; small ones by differences, which stay exact near 0."""
    gx, gy = np.einsum("ij,ij->i", x, x), np.einsum("ij,ij->i", y, y)
    found = x @ y.T
    found *= -2
    found += gx[:, None]
    found += gy
    small = np.flatnonzero(found.ravel() <= _SMALL * (gx.max(initial=0) + gy.max(initial=0)))
    for at in range(0, len(small), 4096):
        i, j = np.divmod(small[at : at + 4096], len(y))
        gap = x[i] - y[j]
        found[i, j] = np.einsum("ij,ij->i", gap, gap)
    return found


def _differences(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Squared distances of one row to others."""
    gap = y - x
    return np.einsum("ij,ij->i", gap, gap)


class _Clusters:
    """The individuals in an order that keeps members of clusters of the same size in planes: the first members of all these
    clusters, then their second ones, and so on, so that a reduction over members is one over planes."""

    def __init__(self, label: np.ndarray) -> None:
        self.by = np.argsort(label, kind="stable")
        self.names, self.first, self.size = np.unique(label[self.by], return_index=True, return_counts=True)
        self.planes = []  # (size, places of these clusters)
        for s in np.unique(self.size):
            self.planes.append((int(s), np.flatnonzero(self.size == s)))
        self.units = np.concatenate([at for _, at in self.planes])
        self.order = np.concatenate([self.plane(s, at).ravel() for s, at in self.planes])

    def plane(self, s: int, at: np.ndarray) -> np.ndarray:
        return self.by[self.first[at] + np.arange(s)[:, None]]

    def members(self, at: int) -> np.ndarray:
        return self.by[self.first[at] : self.first[at] + self.size[at]]

    def reduced(self, d: np.ndarray, add: np.ufunc) -> np.ndarray:
        """Columns in ``order`` to columns in ``units``."""
        if len(self.units) == d.shape[1]:
            return d
        out, c, u = np.empty((len(d), len(self.units)), d.dtype), 0, 0
        for s, at in self.planes:
            w = len(at)
            own = out[:, u : u + w]
            own[:] = d[:, c : c + w]
            for k in range(1, s):
                add(own, d[:, c + k * w : c + (k + 1) * w], out=own)
            c, u = c + s * w, u + w
        return out


def _blocks(clusters: _Clusters, ask: np.ndarray, rows, add: np.ufunc) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places of clusters, reduced distances to all clusters in ``units``); ``rows`` gives those of individuals."""
    for s in np.unique(clusters.size[ask]):
        own = ask[clusters.size[ask] == s]
        step = max(1, _ROWS // int(s))
        for at in range(0, len(own), step):
            part = own[at : at + step]
            plane, found = clusters.plane(int(s), part), None
            for k in range(0, int(s), max(1, _ROWS // len(part))):
                inside = plane[k : k + max(1, _ROWS // len(part))]
                d = rows(inside.ravel()).reshape(*inside.shape, -1)
                d = d[0] if len(d) == 1 else add.reduce(d, axis=0)
                found = d if found is None else add(found, d, out=found)
            yield part, clusters.reduced(found, add)


def _least(v: np.ndarray, k: int) -> np.ndarray:
    """Places of the k least of each row, in any order."""
    wide = v.shape[1]
    if wide <= k:
        return np.broadcast_to(np.arange(wide), v.shape)
    if wide < 64 * k:
        return np.argpartition(v, k - 1, axis=1)[:, :k]
    w = wide // 32  # the least are where the least of 32 columns are
    low = v[:, : w * 32].reshape(len(v), 32, w).min(1)
    pick = np.argpartition(low, k - 1, axis=1)[:, :k]
    where = (pick[:, :, None] + np.arange(32) * w).reshape(len(v), -1)
    where = np.concatenate([where, np.broadcast_to(np.arange(w * 32, wide), (len(v), wide - w * 32))], axis=1)
    return np.take_along_axis(where, np.argpartition(np.take_along_axis(v, where, 1), k - 1, axis=1)[:, :k], 1)


class Lists:
    """What tasks need to find the nearest clusters of some, by a linkage: with "single" an individual's nearest individuals
    of other clusters, else a cluster's nearest clusters."""

    def __init__(self, x: np.ndarray, linkage: str) -> None:
        self.x, self.linkage = x, linkage
        square = np.einsum("ij,ij->i", x, x)
        # Single precision finds the nearest; what it may be wrong by is taken off, so that values are bounds from below.
        wrong = 2 * (x.shape[1] + 8) * 2.0**-24 * (square + square.max(initial=0))
        one = np.ones(len(x))
        self.left = np.concatenate([-2 * x, (square - wrong)[:, None], one[:, None]], axis=1).astype(np.float32)
        self.right = np.concatenate([x, one[:, None], square[:, None]], axis=1).astype(np.float32)

    def find(self, label: np.ndarray, ask: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, float]]:
        """(name, near, distances, bound) of each that is asked for, nearest first, the smaller name first."""
        average, single = self.linkage == "average", self.linkage == "single"
        clusters = _Clusters(np.arange(len(label)) if single else label)
        right = self.right[clusters.order].T
        add = np.add if average else np.maximum

        def rows(own: np.ndarray) -> np.ndarray:
            d = self.left[own] @ right
            return np.sqrt(np.maximum(d, 0, out=d), out=d) if average else d

        place = np.empty(len(clusters.names), np.int64)
        place[clusters.units] = np.arange(len(clusters.units))
        for part, d in _blocks(clusters, np.searchsorted(clusters.names, ask), rows, add):
            if average:
                sizes = clusters.size[clusters.units]
                d = d * ((1 - 2.0**-23 * (clusters.size[part][:, None] + sizes)) / (clusters.size[part][:, None] * sizes))
            if single:
                for k, p in enumerate(part):
                    d[k, label == label[p]] = np.inf
            else:
                d[np.arange(len(part)), place[part]] = np.inf
            least = _least(d, K + 1)
            for k, p in enumerate(part):
                value = d[k, least[k]]
                near = least[k][np.argsort(value)]
                value = d[k, near]
                bound = float(value[K]) if len(value) > K else np.inf
                near = clusters.units[near[:K][np.isfinite(value[:K])]]
                exact = self.exact(clusters, int(p), near)
                order = np.lexsort((near, exact))
                yield int(clusters.names[p]), clusters.names[near[order]], exact[order], bound if average else float(np.sqrt(max(bound, 0)))

    def exact(self, clusters: _Clusters, p: int, near: np.ndarray) -> np.ndarray:
        if not len(near):
            return np.zeros(0)
        sizes = clusters.size[near]
        first = np.cumsum(sizes) - sizes
        y = self.x[np.concatenate([clusters.members(q) for q in near])]
        own = self.x[clusters.members(p)]
        # Single rows by differences, so that equal distances are equal.
        d = np.sqrt(_differences(own[0], y)[None] if len(own) == 1 else squares(own, y))
        found = np.add.reduceat(d.sum(0), first) if self.linkage == "average" else np.maximum.reduceat(d.max(0), first)
        return found / (sizes * clusters.size[p]) if self.linkage == "average" else found


_HELD: dict = {}


def _held(told: Broadcast, linkage: str) -> Lists:
    """A worker's own copy for one matrix, made once."""
    key = (id(told.value), linkage)
    if key not in _HELD:
        _HELD.clear()
        _HELD[key] = Lists(told.value, linkage)
    return _HELD[key]


def shares(weight: np.ndarray, most: int) -> np.ndarray:
    """Where parts of about ``most`` of the weight begin and end; at least one part."""
    upto = np.cumsum(weight)
    cuts = np.searchsorted(upto, np.arange(1, -(-int(upto[-1]) // most)) * most) if len(upto) else []
    return np.array([*np.unique(np.concatenate([[0], cuts])), len(weight)], np.int64) if len(weight) else np.zeros(2, np.int64)


def _asked(spark: SparkSession, told: Broadcast, linkage: str, label: np.ndarray, ask: np.ndarray) -> pa.Table:
    weight = np.ones(len(ask)) if linkage == "single" else np.bincount(label, minlength=len(label))[ask]
    # Every task has some of each size.
    ask = ask[np.argsort(weight, kind="stable")]
    parts = max(1, -(-int(weight.sum()) // _SHARE))
    state = spark.sparkContext.broadcast((label, ask))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lists = _held(told, linkage)
        label, ask = state.value
        for batch in batches:
            for part in batch.column("id").to_pylist():
                if len(own := ask[part::parts]):
                    ids, near, d, bound = zip(*lists.find(label, own), strict=True)
                    yield pa.record_batch([pa.array(ids, pa.int64()), pa.array(near, pa.list_(pa.int64())), pa.array(d, pa.list_(pa.float64())), pa.array(bound, pa.float64())], names=["id", "near", "d", "bound"])

    found = spark.range(0, parts, 1, parts).mapInArrow(run, "id long, near array<long>, d array<double>, bound double").toArrow()
    state.destroy()
    return found


class _Near:
    """Lists of all clusters, on the driver."""

    def __init__(self, spark: SparkSession, told: Broadcast, linkage: str, n: int) -> None:
        self.spark, self.told, self.linkage = spark, told, linkage
        self.ids, self.d, self.bound = np.full((n, K), -1, np.int64), np.full((n, K), np.inf), np.zeros(n)

    def ask(self, label: np.ndarray, ask: np.ndarray) -> None:
        found = _asked(self.spark, self.told, self.linkage, label, ask)
        self.ids[ask], self.d[ask] = -1, np.inf
        for batch in found.to_batches():
            own, size = batch.column("id").to_numpy(), batch.column("near").value_lengths().to_numpy(zero_copy_only=False)
            at = (np.repeat(own, size), np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size))
            self.ids[at], self.d[at] = batch.column("near").flatten().to_numpy(), batch.column("d").flatten().to_numpy()
            self.bound[own] = batch.column("bound").to_numpy()


def same_rows(x: np.ndarray) -> np.ndarray:
    """Of each row the first that is equal."""
    seen: dict[bytes, int] = {}
    return np.array([seen.setdefault(row.tobytes(), i) for i, row in enumerate(x + 0.0)], np.int64)


def merges_of(spark: SparkSession, x: np.ndarray, linkage: str) -> tuple[np.ndarray, ...]:
    """(step, left_id, right_id, size, distance) as arrays: the tree of the rows of x."""
    n, first = len(x), same_rows(x)
    if linkage == "average" and len(np.unique(first)) > LAST:  # where each row counts once
        first = np.arange(n)
    again = np.flatnonzero(first != np.arange(n))
    # Equal rows join the first of them one by one, at distance 0.
    turn = np.zeros(len(again), np.int64)
    seen: dict[int, int] = {}
    for k, f in enumerate(first[again].tolist()):
        turn[k] = seen[f] = seen.get(f, -1) + 1
    found = [(np.zeros(len(again)), turn, first[again], again)]
    kept = np.flatnonzero(first == np.arange(n))
    if len(kept) > 1:
        told = spark.sparkContext.broadcast(np.ascontiguousarray(x[kept]) if len(again) else x)
        weight = np.bincount(first, minlength=n)[kept]
        if linkage == "single":
            d, a, b = _spanning(spark, told, len(kept))
            found.append((d, np.zeros(len(d), np.int64), kept[a], kept[b]))
        else:
            d, turn, a, b = _mutual(spark, told, len(kept), weight, linkage)
            found.append((d, turn, kept[a], kept[b]))
        told.destroy()
    return _numbered(n, *(np.concatenate(c) for c in zip(*found, strict=True)))


def _numbered(n: int, d: np.ndarray, turn: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, ...]:
    """Merges in order of distance, turn and names, with the ids of their parts."""
    order = np.lexsort((b, a, turn, d))
    up, node, size = list(range(n)), list(range(n)), [1] * n

    def root(i: int) -> int:
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    left, right, total = (np.zeros(len(order), np.int64) for _ in range(3))
    for step, k in enumerate(order.tolist()):
        x, y = root(int(a[k])), root(int(b[k]))
        left[step], right[step] = min(node[x], node[y]), max(node[x], node[y])
        if size[x] < size[y]:
            x, y = y, x
        up[y], node[x], size[x] = x, n + step, size[x] + size[y]
        total[step] = size[x]
    return np.arange(len(order)), left, right, total, d[order]


def _spanning(spark: SparkSession, told: Broadcast, n: int) -> tuple[np.ndarray, ...]:
    """(d, a, b): the edges of the minimum spanning tree.

    A component whose shortest edge to others is certain takes it; when none is, the individuals of all but the largest
    component whose bounds leave it open are asked again.
    """
    near = _Near(spark, told, "single", n)
    label, edges = np.arange(n), []
    near.ask(label, label)
    while True:
        names, comp, size = np.unique(label, return_inverse=True, return_counts=True)
        if len(names) == 1:
            d, a, b = (np.array(c) for c in zip(*edges, strict=True))
            return d, a, b
        outside = (near.ids >= 0) & (label[near.ids] != label[:, None])
        at = np.where(outside.any(1), outside.argmax(1), 0)  # lists are sorted
        d = np.where(outside.any(1), near.d[np.arange(n), at], np.inf)
        to = near.ids[np.arange(n), at]
        order = np.lexsort((np.maximum(np.arange(n), to), np.minimum(np.arange(n), to), d, comp))
        best = order[np.concatenate([[True], np.diff(comp[order]) > 0])]
        open_ = d > near.bound  # nearer ones may not be in the list
        least = np.full(len(names), np.inf)
        np.minimum.at(least, comp[open_], near.bound[open_])
        sure = np.isfinite(d[best]) & (d[best] <= least)
        if not sure.any():
            asked = open_ & (near.bound < d[best][comp]) & (comp != size.argmax())
            near.ask(label, np.flatnonzero(asked))
            continue
        up = {}

        def root(i: int, up: dict = up) -> int:
            while i in up:
                i = up[i]
            return i

        own = best[sure]
        for p in own[np.lexsort((np.maximum(own, to[own]), np.minimum(own, to[own]), d[own]))].tolist():
            i, j = root(int(label[p])), root(int(label[to[p]]))
            if i != j:
                up[max(i, j)] = min(i, j)
                edges.append((float(d[p]), min(p, int(to[p])), max(p, int(to[p]))))
        label = np.array([root(int(c)) for c in names])[comp]


def _mutual(spark: SparkSession, told: Broadcast, n: int, weight: np.ndarray, linkage: str) -> tuple[np.ndarray, ...]:
    """(d, round, a, b) of average or complete linkage: clusters that are each other's nearest merge and go by the smaller
    name; the last LAST are one task's."""
    label, size = np.arange(n), weight.astype(float)
    alive, turn, out = np.ones(n, bool), 0, []
    if n > LAST:
        near = _Near(spark, told, linkage, n)
        to, to_d = np.full(n, -1), np.full(n, np.inf)
    comb = (lambda u, v, p, q: (u * p + v * q) / (p + q)) if linkage == "average" else (lambda u, v, p, q: np.maximum(u, v))
    while alive.sum() > LAST:
        live = np.flatnonzero(alive)
        unknown, known = live[to[live] < 0], live[to[live] >= 0]
        x = known[(to[to[known]] == known) & (known < to[known])]
        if len(unknown) and (len(unknown) >= _UNKNOWN * len(live) or not len(x)):
            near.ask(label, unknown)
            to[unknown], to_d[unknown] = near.ids[unknown, 0], near.d[unknown, 0]
            continue
        if not len(x):  # ties in a circle: the nearest pair of all
            k = known[np.lexsort((np.maximum(known, to[known]), np.minimum(known, to[known]), to_d[known]))[:1]]
            x, other = np.minimum(k, to[k]), np.maximum(k, to[k])
            to[x], to_d[x] = other, to_d[k]
        y = to[x]
        out.append((to_d[x], np.full(len(x), turn), x, y))
        turn += 1
        _merge_lists(near, x, y, size, comb)
        merged = np.zeros(n, bool)
        merged[x] = merged[y] = True
        into = np.arange(n)
        into[y] = x
        size[x] += size[y]
        alive[y] = False
        label = into[label]
        live = np.flatnonzero(alive)
        lost = live[merged[live] | ((to[live] >= 0) & merged[to[live]]) | (to[live] < 0)]
        d = near.d[lost]
        low = d.min(1)
        ids = np.where(d == low[:, None], near.ids[lost], n).min(1)
        sure = low < near.bound[lost]
        to[lost], to_d[lost] = np.where(sure, ids, -1), np.where(sure, low, np.inf)
    d, more, a, b = _last(spark, told, label, size, linkage)
    return tuple(np.concatenate(c) for c in zip(*out, (d, more + turn, a, b), strict=True))


def _merge_lists(near: _Near, x: np.ndarray, y: np.ndarray, size: np.ndarray, comb) -> None:
    """Carries all lists over the merges of y into x; ``size`` has the sizes before."""
    ids, dist, bound = near.ids, near.d, near.bound
    n = len(ids)
    for at in range(0, len(x), 4096):
        p, q = x[at : at + 4096], y[at : at + 4096]
        own, other = ids[p], ids[q]
        own_d, other_d = np.where(own == q[:, None], np.inf, dist[p]), np.where(other == p[:, None], np.inf, dist[q])
        sp, sq = size[p][:, None], size[q][:, None]
        both = (own[:, :, None] == other[:, None, :]) & np.isfinite(own_d)[:, :, None] & np.isfinite(other_d)[:, None, :]
        here, there = both.any(2), both.any(1)
        mate = np.take_along_axis(other_d, both.argmax(2), 1)
        value = np.where(here, comb(own_d, np.where(here, mate, 0), sp, sq), np.inf)
        # Clusters in one list only, or in none, are no nearer than the bounds say.
        least = comb(bound[p], bound[q], size[p], size[q])
        least = np.minimum(least, np.where(here | ~np.isfinite(own_d), np.inf, comb(own_d, bound[q][:, None], sp, sq)).min(1))
        least = np.minimum(least, np.where(there | ~np.isfinite(other_d), np.inf, comb(other_d, bound[p][:, None], sq, sp)).min(1))
        ids[p], dist[p], bound[p] = np.where(here, own, -1), value, least
    ids[y], dist[y] = -1, np.inf
    partner = np.full(n + 1, -1)
    partner[x], partner[y] = y, x
    changed = partner[ids] >= 0  # -1 is the last place
    for rows in np.array_split(rows, -(-len(rows) // 4096)) if len(rows := np.flatnonzero(changed.any(1))) else []:
        own, d = ids[rows], dist[rows]
        touched = (partner[own] >= 0) & (own >= 0)
        name = np.where(touched, np.minimum(own, partner[own]), own)
        order = np.argsort(name, axis=1, kind="stable")
        own, d, touched, name = (np.take_along_axis(c, order, 1) for c in (own, d, touched, name))
        met = np.zeros_like(touched)
        met[:, :-1] = touched[:, :-1] & (name[:, :-1] == name[:, 1:])  # both parts are in the list
        second = np.zeros_like(touched)
        second[:, 1:] = met[:, :-1]
        following = np.concatenate([d[:, 1:], d[:, :1]], 1)
        lengths = size[own]
        joined = comb(d, following, lengths, np.concatenate([lengths[:, 1:], lengths[:, :1]], 1))
        alone = touched & ~met & ~second
        low = np.where(alone, comb(d, bound[rows][:, None], lengths, size[partner[own]]), np.inf).min(1)
        bound[rows] = np.minimum(bound[rows], low)
        gone = alone | second
        ids[rows], dist[rows] = np.where(gone, -1, name), np.where(gone, np.inf, np.where(met, joined, d))


def _last(spark: SparkSession, told: Broadcast, label: np.ndarray, size: np.ndarray, linkage: str) -> tuple[np.ndarray, ...]:
    """(d, round, a, b): the merges of LAST clusters at most, by a matrix of their linkage in one task."""
    names = np.unique(label)
    count = np.bincount(label, minlength=len(label))[names]
    weight, cuts = size[names], shares(count, _SHARE)
    parts = len(cuts) - 1
    single = len(names) == len(label)
    state = spark.sparkContext.broadcast(label)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        x, clusters = told.value, _Clusters(state.value)
        y = x if single else x[clusters.order]
        out = np.empty(len(names))

        def of(own: np.ndarray) -> np.ndarray:
            if single:  # by differences, so that equal distances are equal
                return np.array([_differences(x[i], y) for i in own])
            d = squares(x[own], y)
            return np.sqrt(d, out=d) if linkage == "average" else d

        for batch in batches:
            for part in batch.column("id").to_pylist():
                for own, d in _blocks(clusters, np.arange(cuts[part], cuts[part + 1]), of, np.add if linkage == "average" else np.maximum):
                    if linkage == "complete" or single:
                        d = np.sqrt(d)
                    if linkage == "average" and not single:
                        d = d / (clusters.size[own][:, None] * clusters.size[clusters.units])
                    for k, p in enumerate(own.tolist()):
                        out[clusters.units] = d[k]
                        yield pa.record_batch([pa.array([p], pa.int64()), pa.array([out.copy()], pa.list_(pa.float64()))], names=["at", "d"])

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        d = np.zeros((len(names), len(names)))
        for batch in batches:
            for p, row in zip(batch.column("at").to_pylist(), batch.column("d"), strict=True):
                d[p, p + 1 :] = row.values.to_numpy()[p + 1 :]
        columns = last_merges(d, weight, linkage)
        yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, (pa.float64(), pa.int64(), pa.int64(), pa.int64()), strict=True)], names=["d", "round", "a", "b"])

    bound_batches(spark)
    told_rows = spark.range(0, parts, 1, parts).mapInArrow(rows, "at long, d array<double>").repartition(1)
    found = told_rows.mapInArrow(finish, "d double, round long, a long, b long").toArrow()
    state.destroy()
    d, turn, a, b = (found[c].to_numpy() for c in ("d", "round", "a", "b"))
    return d, turn, names[a], names[b]


def last_merges(d: np.ndarray, size: np.ndarray, linkage: str) -> tuple[list, ...]:
    """(d, round, a, b) of places in a matrix, of which the upper half counts; it is overwritten.

    Rounds of mutual nearest neighbours; a row is looked through again only when its nearest has merged.
    """
    for i in range(len(d)):
        d[i:, i] = d[i, i:]
        d[i, i] = np.inf
    n, size = len(d), size.astype(float)
    near = d.argmin(1)
    live, out, turn = np.arange(n), [], 0
    while len(live) > 1:
        x = live[(near[near[live]] == live) & (live < near[live])]
        if not len(x):  # distances that rounding has put into a circle
            low = d[live, near[live]]
            k = live[low.argmin()]
            x = np.array([min(k, near[k])])
            near[x] = max(k, near[k])
        gone = near[x].copy()
        for p, q in zip(x.tolist(), gone.tolist(), strict=True):
            out.append((float(d[p, q]), turn, p, q))
            row = (d[p] * size[p] + d[q] * size[q]) / (size[p] + size[q]) if linkage == "average" else np.maximum(d[p], d[q])
            row[p] = row[q] = np.inf
            d[p], d[:, p], d[q], d[:, q] = row, row, np.inf, np.inf
            size[p] += size[q]
        live = np.setdiff1d(live, gone, assume_unique=True)
        merged = np.zeros(n, bool)
        merged[x] = merged[gone] = True
        again = live[merged[live] | merged[near[live]]]
        near[again] = d[again].argmin(1)
        turn += 1
    return tuple(map(list, zip(*out, strict=True)))
