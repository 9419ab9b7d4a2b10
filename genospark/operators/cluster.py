"""Genetic distances and agglomerative clustering.

Trees are tables of a row a merge.  Where the matrix of individuals fits a broadcast, distances and trees come from it
(``nearest``), and no table of pairs is made; else from tiles and a table of pairs, whose paths upwards are followed by
pointer jumping: each round replaces a node's pointer by its pointer's pointer, so a tree of depth d takes log2 d rounds,
a chain too.  Places of leaves are the driver's, a few numbers an individual; what has a row a pair or a row a cluster and
leaf is written out by tasks from these places, without a join or a shuffle.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..storage import discard, stored
from . import nearest
from .calls import individual_index, marker_index, standardized_entries
from .linalg import pair_blocks, pairs_of
from .ranks import numbered

LINKAGES = ("average", "single", "complete")
#: Individuals whose numbers fit the arrays that trees are walked by.
MAX_INDIVIDUALS = 2**31 - 1
#: Clusters whose last merges are one small task's: 32,640 pairs at most.
FINISH = 256
#: Rows that a task writes out from places, and rows of a batch.
_TASK_ROWS, _BATCH_ROWS = 1 << 22, 1 << 16
#: Leaves of a subtree whose clusters are gone through in one task.
_SUBTREE = 256


def _checked(n: int) -> int:
    if n < 1:
        raise ValueError("no individuals")
    if n > MAX_INDIVIDUALS:
        raise ValueError(f"{n} individuals are over {MAX_INDIVIDUALS}: their pairs are too many")
    return n


def _standardized(calls: DataFrame) -> tuple[DataFrame, int, int]:
    """Entries (i, j, v) of the standardised calls, missing ones being absent, and the numbers of individuals and markers."""
    calls = stored(calls, "distance-calls")
    people = stored(individual_index(calls), "distance-individuals")
    markers = stored(marker_index(calls), "distance-markers")
    n = _checked(people.count())
    entries = standardized_entries(calls).join(markers, "marker").join(F.broadcast(people), "individual")
    return entries.select(F.col("row_idx").alias("i"), F.col("marker_idx").alias("j"), F.col("z").alias("v")), n, markers.count()


def _dealt(spark: SparkSession, weight: np.ndarray, run: Callable[[object, int, int], Iterator[pa.RecordBatch]], state: object, schema: str) -> DataFrame:
    """What ``run(state, first, end)`` makes of the items from ``first`` to before ``end``, about _TASK_ROWS of the weight a
    task, in order.  A lone item is never split, so its weight should be small."""
    cuts = nearest.shares(weight, _TASK_ROWS)
    told = spark.sparkContext.broadcast(state)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in batch.column("id").to_pylist():
                yield from run(told.value, int(cuts[part]), int(cuts[part + 1]))

    return spark.range(0, len(cuts) - 1, 1, len(cuts) - 1).mapInArrow(each, schema)


def _batches(rows: Iterator[tuple[np.ndarray, ...]], names: list[str]) -> Iterator[pa.RecordBatch]:
    """Runs of columns put together to batches of _BATCH_ROWS or more."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += len(row[0])
        if size >= _BATCH_ROWS:
            yield pa.record_batch([pa.array(np.concatenate(c)) for c in zip(*held, strict=True)], names=names)
            held, size = [], 0
    if held:
        yield pa.record_batch([pa.array(np.concatenate(c)) for c in zip(*held, strict=True)], names=names)


def _matrix_pairs(x: np.ndarray, first: int, end: int) -> Iterator[pa.RecordBatch]:
    ids = np.arange(len(x))

    def rows() -> Iterator[tuple[np.ndarray, ...]]:
        for at in range(first, end, 64):
            d = np.sqrt(nearest.squares(x[at : min(at + 64, end)], x[at + 1 :]))
            for k in range(len(d)):
                yield np.full(len(x) - at - k - 1, at + k), ids[at + k + 1 :], d[k, k:]

    yield from _batches(rows(), ["a", "b", "distance"])


def matrix(calls: DataFrame) -> tuple[np.ndarray | None, DataFrame, int]:
    """The matrix of standardised calls, or None if it is too wide to be broadcast, its entries, and the number of individuals."""
    entries, n, m = _standardized(calls)
    return (nearest.rows_of(entries, n, m) if 8 * n * m <= nearest.MATRIX_BYTES else None), entries, n


def pairwise_distances(calls: DataFrame) -> DataFrame:
    """(a, b, distance) for row_idx a < b: Euclidean, on standardised calls, missing ones being 0.

    Small differences are squared and added up, which stays exact near 0.  The result has n (n - 1) / 2 rows.
    """
    x, entries, n = matrix(calls)
    if x is not None:
        return _dealt(calls.sparkSession, np.arange(n - 1, -1, -1), _matrix_pairs, x, "a long, b long, distance double")
    found = pairs_of(pair_blocks(entries, n, "distance"), n).where("a < b")
    return found.select("a", "b", F.sqrt("v").alias("distance"))


def merge_tree(pairs: DataFrame, n: int, linkage: str = "average") -> DataFrame:
    """(step, left_id, right_id, new_id, distance, size) from (a, b, distance) of ids 0 to n - 1.

    Each round merges every pair of clusters that are each other's nearest, ties going to the smaller ids: for these
    linkages that gives the tree of one-by-one merging, ties aside.  Single linkage takes the minimum spanning tree
    instead, in at most log2 n rounds.  Rounds work on a table of cluster pairs that shrinks; steps are numbered by
    distance at the end, and children are found by windows over the numbered merges.  The last FINISH clusters of average
    and complete linkage are merged by the same rounds in one task.
    """
    if linkage not in LINKAGES:
        raise ValueError(f"linkage must be one of {LINKAGES}")
    _checked(n)
    kids = _spanning_tree(pairs, n) if linkage == "single" else _sized(stored(_mutual_merges(pairs, n, linkage), "tree-kids"), n)
    kids = kids.withColumn("new_id", F.col("step") + n)
    return stored(kids.select("step", "left_id", "right_id", "new_id", "distance", "size"), "tree-merges")


def _relabelled(table: DataFrame, told: DataFrame) -> DataFrame:
    """``table`` with a and b replaced by ``told(old, new)``, which has a row an individual at most."""
    for side in "ab":
        table = table.join(F.broadcast(told.withColumnRenamed("old", side)), side, "left").withColumn(side, F.coalesce("new", side)).drop("new")
    return table.where("a != b")


def _to_roots(links: DataFrame) -> DataFrame:
    """(id, up, off) with ``up`` the root and ``off`` the sum on the path to it, from links whose roots point at themselves.

    Three doublings are one job.
    """

    def doubled(t: DataFrame) -> DataFrame:
        far = F.broadcast(t.select(F.col("id").alias("up"), F.col("up").alias("further"), F.col("off").alias("more")))
        return t.join(far, "up").select("id", F.col("further").alias("up"), (F.col("off") + F.col("more")).alias("off"), (F.col("further") != F.col("up")).alias("moved"))

    table = stored(links.select("id", "up", "off"), "tree-links")
    while True:
        longer = stored(doubled(doubled(doubled(table))), "tree-links")
        discard(table)
        if longer.where("moved").isEmpty():
            return longer.drop("moved")
        table = longer


def _spanning_tree(pairs: DataFrame, n: int) -> DataFrame:
    """(step, distance, left_id, right_id, size) of single linkage.

    Round by round each component takes its shortest edge (by distance, then ids) to another and all that hang together
    become one component, until one is left: the minimum spanning tree, whose edges in order are the merges.  What a
    component of a round has merged before its own edge comes is a chain of merges, its *core*: a merge adds to the core
    of its round's component, or of a larger component if the smaller one's edge came before it.
    """
    edge = F.struct(F.col("distance").alias("d"), F.col("a").alias("u"), F.col("b").alias("v")).alias("e")
    table = stored(pairs.select("a", "b", edge), "tree-pairs")
    rounds = []
    while True:
        both = table.select("a", "b", "e").union(table.select(F.col("b").alias("a"), F.col("a").alias("b"), "e"))
        near = stored(both.groupBy("a").agg(F.min(F.struct("e", "b")).alias("p")).select("a", "p.b", "p.e.*"), "tree-nearest")
        if near.isEmpty():
            discard(table, near)
            break
        # Of two components that take the same edge the smaller one is the root; all others hang on what they took.
        back = near.select(F.col("a").alias("b"), F.col("b").alias("again"))
        root = (F.col("again") == F.col("a")) & (F.col("a") < F.col("b"))
        links = near.join(F.broadcast(back), "b").select(F.col("a").alias("id"), F.when(root, F.col("a")).otherwise(F.col("b")).alias("up"), F.lit(0).cast("long").alias("off"))
        roots = _to_roots(links).select(F.col("id").alias("a"), F.col("up").alias("root"))
        taken = stored(near.join(F.broadcast(roots), "a").select(F.lit(len(rounds) + 1).alias("level"), "a", "root", "d", "u", "v"), "tree-taken")
        rounds.append(taken)
        told = taken.select(F.col("a").alias("old"), F.col("root").alias("new"))
        following = stored(_relabelled(table, told).groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.min("e").alias("e")), "tree-pairs")
        discard(table, near)
        table = following
    if not rounds:
        return pairs.sparkSession.createDataFrame([], "step long, distance double, left_id long, right_id long, size long")
    taken = reduce(DataFrame.union, rounds)
    edges = numbered(taken.select("d", "u", "v").distinct(), "step", "d", "u", "v")
    taken = stored(taken.join(F.broadcast(edges), ["d", "u", "v"]), "tree-edges")
    # Each merge climbs to the core that it adds to.
    at = taken.groupBy("step", "d").agg((F.min("level") + 1).alias("in_level"), F.min("root").alias("core"))
    for level in range(2, len(rounds) + 1):
        own = taken.where(F.col("level") == level).select(F.col("a").alias("core"), F.col("root").alias("wider"), F.col("step").alias("leaves"))
        climbs = (F.col("in_level") == level) & (F.col("leaves") < F.col("step"))
        at = at.join(F.broadcast(own), "core", "left").select(
            "step", "d", F.when(climbs, F.lit(level + 1)).otherwise(F.col("in_level")).alias("in_level"), F.when(climbs, F.col("wider")).otherwise(F.col("core")).alias("core")
        )
    at = stored(at, "tree-cores")
    # Cores grow by the whole cores of those that join them, level by level.
    grown: list[DataFrame] = []
    for level in range(2, len(rounds) + 2):
        joining = at.where(F.col("in_level") == level).join(F.broadcast(taken.select("step", "level", "a")), "step")
        joining = joining.withColumn("brings", F.lit(1).cast("long"))
        if grown:
            whole = reduce(DataFrame.union, grown).groupBy(F.col("in_level").alias("level"), F.col("core").alias("a")).agg(F.max("size").alias("whole"))
            joining = joining.join(F.broadcast(whole), ["level", "a"], "left").withColumn("brings", F.coalesce("whole", "brings"))
        brought = joining.groupBy("step", "in_level", "core").agg(F.sum("brings").alias("brings"))
        size = F.sum("brings").over(Window.partitionBy("core").orderBy("step").rowsBetween(Window.unboundedPreceding, 0))
        grown.append(stored(brought.select("step", "in_level", "core", size.alias("size")), "tree-sizes"))
    # A merge joins what its core was to the whole core of the component that took its edge (or of both that did).
    last = at.groupBy(F.col("in_level").alias("level"), F.col("core").alias("a")).agg(F.max("step").alias("last"))
    joins = taken.join(F.broadcast(last), ["level", "a"], "left").groupBy("step").agg(
        F.min(F.coalesce(F.col("last") + n, F.col("a"))).alias("x"), F.max(F.coalesce(F.col("last") + n, F.col("a"))).alias("y"), F.count(F.lit(1)).alias("k")
    )
    before = F.lag("step").over(Window.partitionBy("in_level", "core").orderBy("step")) + n
    both = at.withColumn("before", before).join(joins, "step").withColumn("z", F.when(F.col("k") == 2, F.col("y")).otherwise(F.col("before")))
    both = both.join(F.broadcast(reduce(DataFrame.union, grown).select("step", "size")), "step")
    return both.select("step", F.col("d").alias("distance"), F.least("x", "z").alias("left_id"), F.greatest("x", "z").alias("right_id"), "size")


def _mutual_merges(pairs: DataFrame, n: int, linkage: str) -> DataFrame:
    """(step, distance, left_id, right_id) of average or complete linkage; clusters go by the smallest of their ids."""
    d = "distance"
    table = stored(pairs.select("a", "b", F.col(d).alias("sum"), F.lit(1).cast("long").alias("cnt"), F.col(d).alias("high")), "tree-pairs")
    value = {"average": F.col("sum") / F.col("cnt"), "complete": F.col("high")}[linkage]
    rounds, live = [], n
    while live > max(FINISH, 1):
        near = table.select(value.alias("d"), "a", "b")
        both = near.select("a", F.struct("d", "a", "b").alias("p")).union(near.select(F.col("b").alias("a"), F.struct("d", "a", "b").alias("p")))
        nearest = both.groupBy("a").agg(F.min("p").alias("p"))
        mutual = nearest.groupBy("p").agg(F.count(F.lit(1)).alias("k")).where("k = 2")
        found = stored(mutual.select("p.d", F.lit(len(rounds)).alias("round"), "p.a", "p.b"), "tree-merged")
        live -= found.count()
        rounds.append(found)
        # A merged cluster goes by the smaller of its two ids.
        following = stored(
            _relabelled(table, found.select(F.col("b").alias("old"), F.col("a").alias("new"))).groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
            .agg(F.sum("sum").alias("sum"), F.sum("cnt").alias("cnt"), F.max("high").alias("high")), "tree-pairs",
        )
        discard(table)
        table = following
    if live > 1:  # FINISH (FINISH - 1) / 2 pairs at most
        first = len(rounds)
        rounds.append(stored(table.withColumn("all", F.lit(0)).groupBy("all").applyInArrow(lambda t: _last_merges(t, linkage, first), "d double, round int, a long, b long"), "tree-merged"))
        discard(table)
    if not rounds:
        return pairs.sparkSession.createDataFrame([], "step long, distance double, left_id long, right_id long")
    merges = numbered(reduce(DataFrame.union, rounds), "step", "d", "round", "a", "b")
    # The name a lives on, so its part is the last merge under that name; b's name ends, so its part is the last of all.
    before = F.lag("step").over(Window.partitionBy("a").orderBy("round"))
    last = merges.groupBy(F.col("a").alias("b")).agg(F.max_by("step", "round").alias("last"))
    parts = merges.withColumn("x", F.coalesce(before + n, F.col("a"))).join(F.broadcast(last), "b", "left").withColumn("z", F.coalesce(F.col("last") + n, F.col("b")))
    return parts.select("step", F.col("d").alias("distance"), F.least("x", "z").alias("left_id"), F.greatest("x", "z").alias("right_id"))


def _last_merges(table: pa.Table, linkage: str, first: int) -> pa.Table:
    """The same rounds over a table of few pairs, as matrices."""
    a, b = (table[c].to_numpy() for c in "ab")
    names = np.unique(np.concatenate([a, b]))
    i, j = np.searchsorted(names, a), np.searchsorted(names, b)
    total, count, high = (np.zeros((len(names), len(names))) for _ in range(3))
    for matrix, c in ((total, "sum"), (count, "cnt"), (high, "high")):
        matrix[i, j] = matrix[j, i] = table[c].to_numpy()
    out, live = [], np.arange(len(names))
    while len(live) > 1:
        at = np.ix_(live, live)
        d = total[at] / np.maximum(count[at], 1) if linkage == "average" else high[at].copy()
        np.fill_diagonal(d, np.inf)
        # The nearest by (distance, smaller id, larger id).
        low = d.min(1)
        near = []
        for x in range(len(live)):
            ties = np.flatnonzero(d[x] == low[x])
            near.append(min((min(x, y), max(x, y)) for y in ties))
        pairs = sorted({p for x, p in enumerate(near) if p[0] == x and near[p[1]] == p})
        for x, y in pairs:
            out.append((float(d[x, y]), first, int(names[live[x]]), int(names[live[y]])))
        for x, y in pairs:
            k, gone = live[x], live[y]
            for matrix in (total, count):
                matrix[k] += matrix[gone]
                matrix[:, k] += matrix[:, gone]
            high[k] = np.maximum(high[k], high[gone])
            high[:, k] = np.maximum(high[:, k], high[:, gone])
        live, first = np.delete(live, [y for _, y in pairs]), first + 1
    columns = zip(*out, strict=True)
    return pa.table([pa.array(c, t) for c, t in zip(columns, (pa.float64(), pa.int32(), pa.int64(), pa.int64()), strict=True)], names=["d", "round", "a", "b"])


def _links(kids: DataFrame) -> DataFrame:
    """(id, above) of every child."""
    above = (F.col("new_id")).alias("above")
    return kids.select(F.col("left_id").alias("id"), above).union(kids.select(F.col("right_id").alias("id"), above))


def _sized(kids: DataFrame, n: int) -> DataFrame:
    """``kids`` with new_id and size: leaves less than 2^k steps below, and each node's 2^k-th ancestor, doubled."""
    kids = kids.withColumn("new_id", F.col("step") + n)
    up = stored(_links(kids), "tree-up")
    # A merge's own leaves: those of its children that are leaves.
    leaf = lambda c: (F.col(c) < n).cast("long")
    size = stored(kids.select(F.col("new_id").alias("id"), (leaf("left_id") + leaf("right_id")).alias("size")), "tree-sizes")
    while not up.isEmpty():
        below = size.join(F.broadcast(up), "id").groupBy(F.col("above").alias("id")).agg(F.sum("size").alias("more"))
        larger = stored(size.join(F.broadcast(below), "id", "left").select("id", (F.col("size") + F.coalesce("more", F.lit(0))).alias("size")), "tree-sizes")
        further = stored(up.join(F.broadcast(up.select(F.col("id").alias("above"), F.col("above").alias("beyond"))), "above").select("id", F.col("beyond").alias("above")), "tree-up")
        discard(up, size)
        up, size = further, larger
    discard(up)
    return kids.join(F.broadcast(size.withColumnRenamed("id", "new_id")), "new_id")


def dendrogram(calls: DataFrame, linkage: str = "average") -> DataFrame:
    if linkage not in LINKAGES:
        raise ValueError(f"linkage must be one of {LINKAGES}")
    x, _, n = matrix(calls)
    if x is None:
        return merge_tree(pairwise_distances(calls), n, linkage)
    step, left, right, size, d = nearest.merges_of(calls.sparkSession, x, linkage)
    columns = {"step": step, "left_id": left, "right_id": right, "new_id": step + n, "distance": d, "size": size}
    return stored(calls.sparkSession.createDataFrame(pa.table({k: pa.array(v) for k, v in columns.items()})), "tree-merges")


def _places(merges: DataFrame, n: int) -> tuple[np.ndarray, ...]:
    """(low, size, leaf, gap, height): each node's first place in the order of leaves and its number of leaves, the leaf at
    each place, the step that joins each place to the next, and each step's distance.

    The left side of a merge comes before its right side, so a right child starts where its left sibling ends.
    """
    found = merges.select("step", "left_id", "right_id", "distance", "size").toArrow().sort_by("step")
    step, left, right, height, own = (found[c].to_numpy() for c in ("step", "left_id", "right_id", "distance", "size"))
    size = np.ones(n + len(step), np.int64)
    size[n + step] = own
    low, gap = np.zeros(n + len(step), np.int64), np.zeros(max(n - 1, 0), np.int64)
    places, sizes = low.tolist(), size.tolist()
    for k, a, b in zip(reversed(step.tolist()), reversed(left.tolist()), reversed(right.tolist()), strict=True):
        places[a] = places[n + k]
        places[b] = places[a] + sizes[a]
        gap[places[b] - 1] = k
    low[:] = places
    leaf = np.zeros(n, np.int64)
    leaf[low[:n]] = np.arange(n)
    return low, size, leaf, gap, height


def spans(merges: DataFrame, n: int) -> DataFrame:
    """(id, low, high): the places of each node's leaves in the order of leaves, which are next to each other."""
    low, size, *_ = _places(merges, n)
    return merges.sparkSession.createDataFrame(pa.table({"id": np.arange(len(low)), "low": low, "high": low + size - 1}))


def _joined_pairs(state: tuple[np.ndarray, ...], first: int, end: int) -> Iterator[pa.RecordBatch]:
    leaf, gap, height = state

    def rows() -> Iterator[tuple[np.ndarray, ...]]:
        # What joins two places is the last of the steps between them.
        top = np.maximum.accumulate(gap[end - 1 :])
        for i in range(end - 1, first - 1, -1):
            if i < end - 1:
                top = np.maximum(gap[i], np.concatenate([gap[i : i + 1], top]))
            other = leaf[i + 1 :]
            yield np.minimum(leaf[i], other), np.maximum(leaf[i], other), top, height[top]

    yield from _batches(rows(), ["a", "b", "step", "height"])


def cophenetic(merges: DataFrame, n: int) -> DataFrame:
    """(a, b, step, height) for leaves a < b: the merge that joins them.  n (n - 1) / 2 rows."""
    _, _, leaf, gap, height = _places(merges, n)
    return _dealt(merges.sparkSession, np.arange(n - 1, 0, -1), _joined_pairs, (leaf, gap, height), "a long, b long, step long, height double")


def _apart(state: tuple[np.ndarray, ...], first: int, end: int) -> Iterator[pa.RecordBatch]:
    y, gap = state  # rows in the order of leaves
    pairs, total, high = np.zeros(len(gap), np.int64), np.zeros(len(gap)), np.zeros(len(gap))
    for at in range(first, end, 64):
        upto = min(at + 64, end)
        d = np.sqrt(nearest.squares(y[at:upto], y[at + 1 :]))
        for i in range(at, upto):
            top = np.maximum.accumulate(gap[i:])
            starts = np.flatnonzero(np.concatenate([[True], top[1:] > top[:-1]]))
            own = d[i - at, i - at :]
            steps = top[starts]
            pairs[steps] += np.diff(np.append(starts, len(top)))
            total[steps] += np.add.reduceat(own, starts)
            high[steps] = np.maximum(high[steps], np.maximum.reduceat(own, starts))
    found = np.flatnonzero(pairs)
    yield pa.record_batch([pa.array(c) for c in (found, pairs[found], total[found], high[found])], names=["step", "pairs", "total", "high"])


def joined_distances(merges: DataFrame, x: np.ndarray) -> DataFrame:
    """(step, pairs, mean, high) of the distances between the two sides of each merge, from the matrix."""
    n = len(x)
    _, _, leaf, gap, _ = _places(merges, n)
    found = _dealt(merges.sparkSession, np.arange(n - 1, 0, -1), _apart, (x[leaf], gap), "step long, pairs long, total double, high double")
    return found.groupBy("step").agg(F.sum("pairs").alias("pairs"), (F.sum("total") / F.sum("pairs")).alias("mean"), F.max("high").alias("high"))


class _Lives:
    """The least linkage of two clusters at each step, by the clusters as they come up.

    Clusters that are there together keep their linkage until one of them merges.  So each cluster, when it is made, meets
    all that are alive then, which are intervals of the order of leaves: cut where leaves are joined at a later step.
    """

    def __init__(self, y: np.ndarray, low: np.ndarray, size: np.ndarray, gap: np.ndarray, ends: np.ndarray, average: bool) -> None:
        self.y, self.low, self.size, self.gap, self.average = y, low, size, gap, average
        self.n, self.least = len(y), np.full(len(gap), np.inf)
        self.ends = ends  # of each node, the step that merges it
        self.op = np.add if average else np.maximum

    def distances(self, node: int) -> np.ndarray:
        """Of a node's leaves to all leaves, a row a leaf."""
        return np.sqrt(nearest.squares(self.y[self.low[node] : self.low[node] + self.size[node]], self.y))

    def made(self, node: int, d: np.ndarray, nodes: np.ndarray, starts: np.ndarray) -> None:
        """``node`` meets ``nodes``, all that are alive and where they start; d has its linkage by leaf, average as a sum."""
        found = self.op.reduceat(d, starts)
        if self.average:
            found = found / (self.size[nodes] * self.size[node])
        found[nodes == node] = np.inf
        until, since = int(self.ends[node]), max(node - self.n + 1, 0)
        low = np.full(until - since + 1, np.inf)
        np.minimum.at(low, np.minimum(self.ends[nodes], until) - since, found)
        own = self.least[since : until + 1]
        np.minimum(own, np.minimum.accumulate(low[::-1])[::-1], out=own)


def _alive(gap: np.ndarray, named: tuple[np.ndarray, np.ndarray], step: int) -> tuple[np.ndarray, np.ndarray]:
    """Nodes alive after a step, and where they start."""
    starts = np.concatenate([[0], np.flatnonzero(gap > step) + 1])
    first, nodes = named
    # Of the nodes that start at a place (sorted by place, then id) the last that is not newer than the step.
    n = len(gap) + 1
    at = np.searchsorted(first, starts * (2 * n) + n + step, "right") - 1
    return nodes[at], starts


def least_linkages(merges: DataFrame, x: np.ndarray, linkage: str) -> DataFrame:
    """(step, least): the least linkage of the clusters alive before each merge, from the matrix.

    Subtrees of up to _SUBTREE leaves are tasks; a last task goes through the nodes above them.
    """
    n, spark, average = len(x), merges.sparkSession, linkage == "average"
    low, size, leaf, gap, _ = _places(merges, n)
    kids = merges.select("step", "left_id", "right_id").toArrow().sort_by("step")
    left, right = kids["left_id"].to_numpy(), kids["right_id"].to_numpy()
    ends = np.full(n + len(left), len(left) - 1)  # the root never ends
    ends[left] = ends[right] = np.arange(len(left))
    ids = np.arange(len(low))
    order = np.lexsort((ids, low))
    named = (low[order] * (2 * n) + ids[order], ids[order])
    small = size <= _SUBTREE
    tops = np.flatnonzero(small & (~small[n + ends] | (ids == len(low) - 1)))
    tops = tops[np.argsort(low[tops])]
    state = (x[leaf], low, size, gap, ends, average)

    def told(lives: _Lives) -> pa.RecordBatch:
        found = np.flatnonzero(np.isfinite(lives.least))
        return pa.record_batch([pa.array(found), pa.array(lives.least[found])], names=["step", "least"])

    def raised(lives: _Lives, first: int, count: int, held: dict[int, np.ndarray]) -> None:
        """Nodes from ``first`` within ``count`` leaves, or with ``count`` 0 those above all subtrees, in order of their steps."""
        inside = (low[n:] >= first) & (low[n:] + size[n:] <= first + count) if count else ~small[n:]
        for k in np.flatnonzero(inside).tolist():
            a, b = int(left[k]), int(right[k])
            d = lives.op(_taken(lives, a, held), _taken(lives, b, held))
            held[n + k] = d
            if n + k < len(low) - 1:
                lives.made(n + k, d, *_alive(gap, named, k))

    def subtree(state: tuple, first: int, end: int) -> Iterator[pa.RecordBatch]:
        lives = _Lives(*state)
        nodes, starts = leaf, np.arange(n)
        for top in tops[first:end].tolist():
            at, held = int(low[top]), {}
            for i in range(at, at + int(size[top]), 64):
                d = np.sqrt(nearest.squares(lives.y[i : min(i + 64, at + int(size[top]))], lives.y))
                for k in range(len(d)):
                    held[int(leaf[i + k])] = d[k]
                    lives.made(int(leaf[i + k]), d[k], nodes, starts)
            raised(lives, at, int(size[top]), held)
        yield told(lives)

    def above(state: tuple, first: int, end: int) -> Iterator[pa.RecordBatch]:
        lives = _Lives(*state)
        raised(lives, 0, 0, {})
        yield told(lives)

    found = _dealt(spark, size[tops] * (_TASK_ROWS // (4 * _SUBTREE)), subtree, state, "step long, least double")
    found = found.union(_dealt(spark, np.ones(1), above, state, "step long, least double"))
    return found.groupBy("step").agg(F.min("least").alias("least"))


def _taken(lives: _Lives, node: int, held: dict[int, np.ndarray]) -> np.ndarray:
    """A node's linkage by leaf: held by its own merge, or made from its leaves."""
    if node in held:
        return held.pop(node)
    first, end, found = int(lives.low[node]), int(lives.low[node] + lives.size[node]), None
    for i in range(first, end, 256):
        d = lives.op.reduce(np.sqrt(nearest.squares(lives.y[i : min(i + 256, end)], lives.y)), axis=0)
        found = d if found is None else lives.op(found, d)
    return found


def _inside(state: tuple[np.ndarray, ...], first: int, end: int) -> Iterator[pa.RecordBatch]:
    low, size, leaf = state
    yield from _batches(((np.full(size[k], k), leaf[low[k] : low[k] + size[k]]) for k in range(first, end)), ["id", "leaf"])


def members(merges: DataFrame, n: int) -> DataFrame:
    """(id, leaf): the leaves below each cluster, leaves included; as many rows as the tree's leaves have ancestors."""
    low, size, leaf, *_ = _places(merges, n)
    return _dealt(merges.sparkSession, size, _inside, (low, size, leaf), "id long, leaf long")


def _named(state: tuple, first: int, end: int) -> Iterator[pa.RecordBatch]:
    low, size, place, names, left, right, height = state

    def text(k: int) -> str:
        return ";".join(names[np.sort(place[low[k] : low[k] + size[k]])].tolist())

    for step in range(first, end):
        columns = [pa.array([step], pa.int64()), pa.array([text(left[step])]), pa.array([text(right[step])]), pa.array([height[step]], pa.float64())]
        yield pa.record_batch(columns, names=["step", "left", "right", "distance"])


def named_merges(merges: DataFrame, calls: DataFrame) -> DataFrame:
    """(step, left, right, distance), in order, with each side's members sorted and joined by semicolons."""
    people = individual_index(calls).toArrow().sort_by("row_idx")["individual"].to_numpy(zero_copy_only=False)
    n = len(people)
    low, size, leaf, _, height = _places(merges, n)
    found = merges.select("step", "left_id", "right_id").toArrow().sort_by("step")
    order = np.argsort(people)
    place = np.empty(n, np.int64)
    place[order] = np.arange(n)
    state = (low, size, place[leaf], people[order], found["left_id"].to_numpy(), found["right_id"].to_numpy(), height)
    return _dealt(merges.sparkSession, size[n:], _named, state, "step long, left string, right string, distance double")


def leaf_order(merges: DataFrame, n: int) -> DataFrame:
    """(leaf, position): the left side of every merge before its right side."""
    return spans(merges, n).where(F.col("id") < n).select(F.col("id").alias("leaf"), F.col("low").alias("position"))


def segments(merges: DataFrame, n: int) -> DataFrame:
    """(step, segment, x1, y1, x2, y2): the five lines of each merge of a drawn tree."""
    height = merges.select(F.col("new_id").alias("id"), "distance")
    drawn = spans(merges, n).join(F.broadcast(height), "id", "left").select(
        "id", "low", "high", ((F.col("low") + F.col("high")) / 2).alias("mid"), F.coalesce("distance", F.lit(0.0)).alias("distance")
    )
    side = lambda s: F.broadcast(drawn.select(*[F.col(c).alias(f"{s}_{c}") for c in ("id", "low", "high", "mid", "distance")]))
    both = merges.join(side("left"), "left_id").join(side("right"), "right_id")
    line = lambda k, x1, y1, x2, y2: F.struct(F.lit(k).alias("segment"), *[F.col(c).cast("double").alias(a) for a, c in (("x1", x1), ("y1", y1), ("x2", x2), ("y2", y2))])
    lines = F.array(
        line(0, "left_low", "left_distance", "left_high", "left_distance"), line(1, "right_low", "right_distance", "right_high", "right_distance"),
        line(2, "left_mid", "distance", "right_mid", "distance"), line(3, "left_mid", "left_distance", "left_mid", "distance"),
        line(4, "right_mid", "right_distance", "right_mid", "distance"),
    )
    return both.select("step", F.explode(lines).alias("s")).select("step", "s.*")
