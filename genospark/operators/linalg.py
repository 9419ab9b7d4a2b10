"""Matrix products: coordinate tables by joins, Gram matrices by blocks of rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import stored

#: Sides above this are not brought to the driver; a task holds one matrix of this side at most (128 MB).  Beyond it
#: ``top_eigenpairs`` and ``solve_ridge`` work by passes over the rows.
MAX_SIDE = 4096
_BLOCK = 256
#: Entries of sparse rows that a task works on at a time, and rows of a result that travel in one block.
_ENTRIES, _PART = 1 << 20, 1 << 12
#: An inner index of over 1 / HEAVY of a table's entries is split, into SALTS parts of each table.
HEAVY, SALTS = 200, 8
#: Bytes of vectors that a pass broadcasts at most.
MAX_BROADCAST = 1 << 30
#: Bytes of an Arrow batch where rows are whole tiles.
_BATCH_BYTES = 16 << 20
_EMPTY = np.zeros((_BLOCK, _BLOCK))


def bound_batches(spark: SparkSession) -> None:
    """Keeps an Arrow batch of rows with arrays within bounds."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(_BATCH_BYTES))


def matmul(a: DataFrame, b: DataFrame) -> DataFrame:
    """(i, j, v) of a times b; zeros take no part."""
    return dealt_products(a, b).groupBy("i", F.col("c").alias("j")).agg(F.sum(F.col("v") * F.col("w")).alias("v"))


def dealt_products(a: DataFrame, b: DataFrame) -> DataFrame:
    """The pairs of entries whose products make a times b, met by the inner index j and two salts x and y.

    An inner index that holds over 1 / HEAVY of either table's entries would be one task's: its entries of a are dealt
    to SALTS parts by their row and its entries of b, by their column, to as many, so that its products meet in
    SALTS x SALTS tasks, each entry being copied SALTS times.  There are 2 HEAVY such indices at most.
    """
    left, right = (m.where("v != 0").select("i", "j", "v") for m in (a, b))
    right = right.select(F.col("i").alias("j"), F.col("j").alias("c"), F.col("v").alias("w"))
    counts = left.groupBy("j").agg(F.count(F.lit(1)).alias("n"), F.lit(0).cast("long").alias("m")).union(right.groupBy("j").agg(F.lit(0).cast("long").alias("n"), F.count(F.lit(1)).alias("m")))
    counts = counts.groupBy("j").agg(F.sum("n").alias("n"), F.sum("m").alias("m"))
    shares = stored(counts, "product-counts")
    whole = shares.agg(F.sum("n").alias("n"), F.sum("m").alias("m")).first()
    heavy = shares.where((F.col("n") * HEAVY > (whole["n"] or 0)) | (F.col("m") * HEAVY > (whole["m"] or 0))).where("n > 0 and m > 0")
    heavy = F.broadcast(heavy.select("j", F.lit(True).alias("heavy")))
    all_salts = F.sequence(F.lit(0), F.lit(SALTS - 1))

    def dealt(t: DataFrame, own: str, mine: str, other: str) -> DataFrame:
        part = F.pmod(F.xxhash64(own), F.lit(SALTS)).cast("int")
        marked = t.join(heavy, "j", "left")
        copied = marked.withColumn(mine, F.when(F.col("heavy"), part).otherwise(0))
        return copied.withColumn(other, F.explode(F.when(F.col("heavy"), all_salts).otherwise(F.array(F.lit(0))))).drop("heavy")

    return dealt(left, "i", "x", "y").join(dealt(right, "c", "y", "x"), ["j", "x", "y"])


def transpose(a: DataFrame) -> DataFrame:
    return a.select(F.col("j").alias("i"), F.col("i").alias("j"), "v")


def matvec(a: DataFrame, x: DataFrame) -> DataFrame:
    """(i, v) of a times x(j, v)."""
    return a.join(x.select("j", F.col("v").alias("w")), "j").groupBy("i").agg(F.sum(F.col("v") * F.col("w")).alias("v"))


def covariance(entries: DataFrame, n: int) -> DataFrame:
    """(mi, mj, v) for mi <= mj from centred entries (individual, m, z), absent entries being 0.

    The plain form, for few markers, by a join; ``covariance_blocks`` is the form for many.
    """
    a = entries.select("individual", F.col("m").alias("mi"), F.col("z").alias("zi"))
    b = entries.select("individual", F.col("m").alias("mj"), F.col("z").alias("zj"))
    joined = a.join(b, "individual").where("mi <= mj")
    return joined.groupBy("mi", "mj").agg((F.sum(F.col("zi") * F.col("zj")) / (n - 1)).alias("v"))


def covariance_blocks(entries: DataFrame, n: int, markers: int) -> DataFrame:
    """(p, q, v) for blocks p <= q of 256 markers: the covariance of centred entries (individual long, m, z), by tiles.

    No task holds more than a block; ``pairs_of`` makes (a, b, v) of it.
    """
    z = F.col("z") / F.sqrt(F.lit(float(n - 1)))
    return pair_blocks(entries.select(F.col("m").alias("i"), F.col("individual").alias("j"), z.alias("v")), markers, "product")


def pair_blocks(entries: DataFrame, n: int, kind: str) -> DataFrame:
    """(p, q, v) for blocks p <= q of 256 rows: by pair of rows the sum over columns of products or squared differences.

    ``entries(i, j, v)`` has rows 0 to n - 1 and any long columns; absent entries are 0.  A block of rows is cut into
    tiles of 256 columns; each tile goes to every pair that its block is in, and a task streams the sorted tiles of a
    pair into one block of sums.  So a task holds two tiles and that block, whatever n and the number of columns.  A tile
    has at most 65,536 entries and is copied once for each block of rows: n / 256 times.
    """
    if kind not in ("product", "distance"):
        raise ValueError(f"no kind {kind!r}")
    spark = entries.sparkSession
    bound_batches(spark)
    blocks, width = max(1, -(-n // _BLOCK)), int(spark.conf.get("spark.sql.shuffle.partitions"))
    cell = lambda c: F.pmod(F.col(c), F.lit(_BLOCK)).cast("short")
    part = lambda c: F.floor(F.col(c) / _BLOCK).cast("long")
    tiles = entries.groupBy(part("i").cast("int").alias("own"), part("j").alias("tile")).agg(F.collect_list(F.struct(cell("i").alias("r"), cell("j").alias("c"), F.col("v").cast("double").alias("v"))).alias("e"))
    tiles = tiles.select("own", "tile", F.col("e.r").alias("r"), F.col("e.c").alias("c"), F.col("e.v").alias("v"))
    dealt = tiles.withColumn("partner", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    dealt = dealt.select(F.least("own", "partner").alias("p"), F.greatest("own", "partner").alias("q"), "tile", "own", "r", "c", "v")
    # Every pair has a row, also one without an entry.
    none = [F.array().cast(f"array<{t}>").alias(c) for c, t in (("r", "smallint"), ("c", "smallint"), ("v", "double"))]
    every = spark.range(blocks).select(F.col("id").cast("int").alias("p"), F.explode(F.sequence(F.col("id").cast("int"), F.lit(blocks - 1))).alias("q"))
    dealt = dealt.union(every.select("p", "q", F.lit(-1).cast("long").alias("tile"), F.col("p").alias("own"), *none))
    ordered = dealt.repartition(width, "p", "q").sortWithinPartitions("p", "q", "tile")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, tile, total, sides = None, None, None, {}

        def add() -> None:
            left, right = (sides.get(k, _EMPTY) for k in held)
            if kind == "product":
                total[:] += left @ right.T
            else:  # by differences, which stay exact near 0
                for k in range(_BLOCK):
                    gap = right - left[k]
                    total[k] += np.einsum("ij,ij->i", gap, gap)

        def out() -> pa.RecordBatch:
            columns = [pa.array([held[0]], pa.int32()), pa.array([held[1]], pa.int32()), pa.array([total.reshape(-1)], pa.list_(pa.float64()))]
            return pa.record_batch(columns, names=["p", "q", "v"])

        for batch in batches:
            for k in range(batch.num_rows):
                key, at, own = (batch.column("p")[k].as_py(), batch.column("q")[k].as_py()), batch.column("tile")[k].as_py(), batch.column("own")[k].as_py()
                if (key, at) != (held, tile) and sides:
                    add()
                    sides = {}
                if key != held:
                    if held is not None:
                        yield out()
                    held, total = key, np.zeros((_BLOCK, _BLOCK))
                tile = at
                r, c, v = (batch.column(x)[k].values.to_numpy(zero_copy_only=False) for x in ("r", "c", "v"))
                if len(v):
                    sides[own] = np.zeros((_BLOCK, _BLOCK))
                    sides[own][r, c] = v
        if held is not None:
            if sides:
                add()
            yield out()

    return ordered.mapInArrow(run, "p int, q int, v array<double>")


def pairs_of(blocks: DataFrame, n: int) -> DataFrame:
    """(a, b, v) for rows a <= b below n, from ``pair_blocks``."""
    long = blocks.select("p", "q", F.posexplode("v").alias("at", "v"))
    a, b = (F.col("p") * F.lit(_BLOCK).cast("long") + F.expr(f"at div {_BLOCK}")), (F.col("q") * F.lit(_BLOCK).cast("long") + F.col("at") % _BLOCK)
    return long.select(a.alias("a"), b.alias("b"), "v").where((F.col("a") <= F.col("b")) & (F.col("b") < n))


class NotConverged(ArithmeticError):
    """An iterative solver used up its passes."""


def add_blocks(parts: DataFrame) -> DataFrame:
    """(key, block, v): arrays of the same key and block added up; a task streams sorted parts and holds one sum."""
    width = int(parts.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, total = None, None
        out = lambda: pa.record_batch([pa.array([held[0]], pa.int32()), pa.array([held[1]], pa.int32()), pa.array([total], pa.list_(pa.float64()))], names=["key", "block", "v"])
        for batch in batches:
            for key, block, v in zip(batch.column("key").to_pylist(), batch.column("block").to_pylist(), batch.column("v"), strict=True):
                value = v.values.to_numpy()
                if (key, block) == held:
                    total += value
                    continue
                if held is not None:
                    yield out()
                held, total = (key, block), value.copy()
        if held is not None:
            yield out()

    ordered = parts.repartition(width, "key", "block").sortWithinPartitions("key", "block")
    return ordered.mapInArrow(run, "key int, block int, v array<double>")


def sparse_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray]]:
    """Runs of sparse rows of about _ENTRIES entries, with the index, value and row of each entry."""
    for batch in batches:
        upto = np.cumsum(batch.column("idx").value_lengths().to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < batch.num_rows:
            before = upto[at - 1] if at else 0
            end = max(at + 1, int(np.searchsorted(upto, before + _ENTRIES, "right")))
            part = batch.slice(at, end - at)
            row = np.repeat(np.arange(end - at), np.diff(np.concatenate([[before], upto[at:end]])))
            yield part, part.column("idx").flatten().to_numpy(), part.column("v").flatten().to_numpy(), row
            at = end


def gram(rows: DataFrame, width: int, keyed: bool = False) -> DataFrame:
    """(key, block, v): the sums over rows of x x' by key, as flattened blocks of 256 rows of the Gram matrix.

    ``rows`` has (key int, idx array<int>, v array<double>, fill double), a sparse row each: what is absent is
    ``fill``.  Each task keeps one matrix, so rows of several keys (``keyed``) are sorted by key; Spark adds up the
    blocks.
    """

    def blocks(key: int, total: np.ndarray) -> Iterator[pa.RecordBatch]:
        for block, first in enumerate(range(0, width, _BLOCK)):
            flat = total[first : first + _BLOCK].reshape(-1)
            yield pa.record_batch([pa.array([key], pa.int32()), pa.array([block], pa.int32()), pa.array([flat], pa.list_(pa.float64()))], names=["key", "block", "v"])

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, total = None, np.zeros((0, 0))
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                keys, fill = (part.column(c).to_numpy() for c in ("key", "fill"))
                sizes = part.column("idx").value_lengths().to_numpy(zero_copy_only=False)
                x = np.repeat(fill[:, None], width, 1)
                x[np.repeat(np.arange(len(sizes)), sizes), part.column("idx").flatten().to_numpy()] = part.column("v").flatten().to_numpy()
                for key in np.unique(keys):
                    own = x[keys == key]
                    if key != held:
                        if held is not None:
                            yield from blocks(held, total)
                        held, total = int(key), np.zeros((width, width))
                    total += own.T @ own
        if held is not None:
            yield from blocks(held, total)

    ordered = rows.sortWithinPartitions("key") if keyed else rows
    return add_blocks(ordered.mapInArrow(partial, "key int, block int, v array<double>"))


def collect_gram(blocks: DataFrame, width: int) -> np.ndarray:
    """The symmetric matrix of the only key; the side is checked before anything is collected."""
    if width > MAX_SIDE:
        raise ValueError(f"a side of {width} is over {MAX_SIDE}")
    found = blocks.select("block", "v").toArrow().sort_by("block")
    flat = found["v"].combine_chunks().flatten().to_numpy()
    return flat.reshape(width, width) if len(flat) else np.zeros((width, width))


def gram_times(rows: DataFrame, vectors: np.ndarray, skip: np.ndarray | None = None) -> np.ndarray:
    """The sum over sparse rows x (absent entries 0) of x (x' V), by one pass.

    ``vectors`` has a row per index and few columns; it is broadcast, so its size is checked, and each task sends one
    such matrix in parts.  With ``skip``, a key a column, a column's sum leaves out the rows of that key.
    """
    if vectors.nbytes > MAX_BROADCAST:
        raise ValueError(f"{vectors.nbytes} bytes of vectors are over {MAX_BROADCAST}")
    bound_batches(rows.sparkSession)
    told = rows.sparkSession.sparkContext.broadcast(vectors)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = told.value
        total = np.zeros_like(v)
        for part, idx, value, row in sparse_parts(batches):
            keys = part.column("key").to_numpy()
            for c in range(v.shape[1]):
                y = np.bincount(row, value * v[idx, c], part.num_rows)
                if skip is not None:
                    y[keys == skip[c]] = 0
                total[:, c] += np.bincount(idx, value * y[row], len(v))
        for block, first in enumerate(range(0, len(v), _PART)):
            flat = total[first : first + _PART].reshape(-1)
            yield pa.record_batch([pa.array([0], pa.int32()), pa.array([block], pa.int32()), pa.array([flat], pa.list_(pa.float64()))], names=["key", "block", "v"])

    found = add_blocks(rows.mapInArrow(partial, "key int, block int, v array<double>")).select("block", "v").toArrow().sort_by("block")
    flat = found["v"].combine_chunks().flatten().to_numpy()
    return flat.reshape(vectors.shape) if len(flat) else np.zeros_like(vectors)


def top_eigenpairs(rows: DataFrame, width: int, k: int, tolerance: float = 1e-8, most: int = 100, depth: int = 4) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k largest eigenvalues of the Gram matrix of sparse rows, their vectors (width, k), largest first, and residuals:
    the norm of G v - l v as a share of the largest eigenvalue.

    The matrix itself for sides up to MAX_SIDE.  Beyond, a block Krylov space: each pass over the (stored) rows multiplies
    the residuals of the best k + 8 vectors and widens the space by them, which is cut to its best half when it has
    ``depth`` times that width.  It ends when all k residuals are below ``tolerance``; after ``most`` passes it raises
    NotConverged.
    """
    if width <= MAX_SIDE:
        g = collect_gram(gram(rows, width), width)
        values, vectors = np.linalg.eigh(g)
        values, vectors = values[::-1][:k], vectors[:, ::-1][:, :k]
        return values, vectors, np.linalg.norm(g @ vectors - vectors * values, axis=0) / max(values.max(initial=0), 1e-300)
    wide = min(k + 8, width)
    space = np.linalg.qr(np.random.default_rng(0).normal(size=(width, wide)))[0]
    images = gram_times(rows, space)
    for _ in range(most):
        values, turn = np.linalg.eigh((space.T @ images + images.T @ space) / 2)
        values, turn = values[::-1], turn[:, ::-1]
        best, moved = space @ turn[:, :wide], images @ turn[:, :wide]
        rest = moved - best * values[:wide]
        gap = np.linalg.norm(rest, axis=0) / max(values[0], 1e-300)
        if (gap[:k] <= tolerance).all():
            return values[:k], best[:, :k], gap[:k]
        if space.shape[1] + wide > min(depth * wide, width):
            space, images = space @ turn[:, : 2 * wide], images @ turn[:, : 2 * wide]
        for _ in range(2):  # once leaves parts of the space in what is small
            rest = rest - space @ (space.T @ rest)
        left, size, _ = np.linalg.svd(rest, full_matrices=False)
        fresh = left[:, size > 1e-12 * max(values[0], 1e-300)]
        if not fresh.shape[1]:  # the space is closed
            return values[:k], best[:, :k], gap[:k]
        fresh = np.linalg.qr(fresh - space @ (space.T @ fresh))[0]
        space, images = np.concatenate([space, fresh], 1), np.concatenate([images, gram_times(rows, fresh)], 1)
    raise NotConverged(f"eigenvectors: residuals {gap[:k].max():.1e} after {most} passes, wanted {tolerance:.0e}")


def solve_ridge(times, right: np.ndarray, alpha: float, tolerance: float = 1e-10, most: int = 2000) -> np.ndarray:
    """x of (G + alpha I) x = right by conjugate gradients, for each column of ``right`` with a G of its own.

    ``times`` gives all columns' products with their G in one pass, so passes do not grow with the columns.  Raises
    NotConverged after ``most`` passes.
    """
    x, rest = np.zeros_like(right), right.copy()
    way, size = rest.copy(), (rest * rest).sum(0)
    enough = tolerance**2 * np.maximum(size, 1e-300)
    for _ in range(most):
        going = size > enough
        if not going.any():
            return x
        moved = times(way) + alpha * way
        step = np.where(going, size / np.where(going, (way * moved).sum(0), 1), 0)
        x, rest = x + step * way, rest - step * moved
        old, size = size, np.where(going, (rest * rest).sum(0), size)
        way = np.where(going, rest + size / np.where(old > 0, old, 1) * way, way)
    raise NotConverged(f"ridge: a residual of {np.sqrt((size / np.maximum(enough, 1e-300)).max()) * tolerance:.1e} after {most} passes, wanted {tolerance:.0e}")


def sparse_rows(entries: DataFrame, row: str, idx: str, value: str, key: str | None = None, fill: str | None = None) -> DataFrame:
    """Entries to the rows that ``gram`` takes."""
    keys = [F.lit(0).cast("int").alias("key") if key is None else F.col(key).cast("int").alias("key")]
    fills = F.first(F.lit(0.0) if fill is None else F.col(fill)).alias("fill")
    grouped = entries.groupBy(row, *keys).agg(F.collect_list(F.struct(F.col(idx).cast("int").alias("i"), F.col(value).alias("v"))).alias("e"), fills)
    return grouped.select("key", F.col("e.i").alias("idx"), F.col("e.v").alias("v"), "fill")
