"""Context-tree weighting in one table: the whole tree of few texts, which the distributed scoring must equal."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from genospark.llm.common import stored
from genospark.llm.lm_scoring import DEPTH, END, _codes, _contexts, _kt, count_pairs

#: Contexts that are kept at most (a row of 256 floats each).
MAX_CONTEXTS = 1 << 15


def count_contexts(texts: DataFrame) -> DataFrame:
    """(context long, byte int, n long) over all texts in column ``raw`` (binary)."""
    pairs = count_pairs(texts.select("raw", F.lit(False).alias("ask"), F.lit(True).alias("learn")))
    return pairs.select(F.shiftright("pair", 8).alias("context"), F.col("pair").bitwiseAND(F.lit(255)).cast("int").alias("byte"), "n")


def _nodes(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rows, 256) byte counts -> counts of bit 0 and bit 1 at the 255 nodes of the byte's binary tree, heap order."""
    levels = [counts]
    while levels[0].shape[1] > 1:
        levels.insert(0, levels[0][:, 0::2] + levels[0][:, 1::2])
    return tuple(np.concatenate([x[:, b::2] for x in levels[1:]], 1) for b in (0, 1))


def _byte_logs(ones: np.ndarray) -> np.ndarray:
    """(rows, 255) probabilities of bit 1 -> (rows, 256) natural log probabilities of bytes."""
    out, first = np.zeros((len(ones), 1)), 0
    for level in range(8):
        p = ones[:, first : first + (1 << level)]
        both = np.stack([np.log1p(-p), np.log(p)], 2) + out[:, :, None]
        out, first = both.reshape(len(ones), 2 << level), first + (1 << level)
    return out.astype(np.float32)


@dataclass
class Tree:
    """``step``: (inner contexts, 256), the state that an older byte leads to; states from len(step) on are final
    and have a row in ``logs``."""

    step: np.ndarray
    logs: np.ndarray
    depth: int

    def log_probability(self, texts: list[bytes]) -> np.ndarray:
        """Natural log probability of each text, END included."""
        data, starts = _codes(texts, self.depth)
        inner = len(self.step)
        state = np.zeros(len(data) - self.depth, np.int32)
        flat = self.step.reshape(-1)
        for back in range(1, self.depth + 1):
            old = data[self.depth - back : len(data) - back]
            if back == 1:
                state = flat[old]
            else:
                open_ = np.flatnonzero(state < inner)
                state[open_] = flat[state[open_].astype(np.int64) * 256 + old[open_]]
        logs = self.logs.reshape(-1)[(state.astype(np.int64) - inner) * 256 + data[self.depth :]]
        total = np.concatenate([[0.0], np.cumsum(logs, dtype=np.float64)])
        first = starts - self.depth
        last = first + np.array([len(t) + 1 for t in texts], np.int64)
        return total[last] - total[first]


def build_tree(context: np.ndarray, byte: np.ndarray, n: np.ndarray, by_depth: list[np.ndarray], depth: int = DEPTH) -> Tree:
    """The weighted tree from counts of kept contexts.

    ``by_depth[d]`` are the kept contexts of d bytes, sorted; ``context``, ``byte`` and ``n`` are counts of kept
    contexts, with the depth in the context's bits from 40 on.
    """
    counts = []
    for d, kept in enumerate(by_depth):
        of = context >> 40 == d
        table = np.zeros((len(kept), 256), np.float64)
        np.add.at(table, (np.searchsorted(kept, context[of] & ((1 << 40) - 1)), byte[of]), n[of])
        counts.append(table.astype(np.float32))
    parent_at = [None] + [np.searchsorted(by_depth[d - 1], by_depth[d] & ((1 << 8 * (d - 1)) - 1)) for d in range(1, depth + 1)]
    # Upwards: the weighted probability of a context is half its own estimate and half the product of its branches.
    share: list = [None] * (depth + 1)
    other: list = [None] * (depth + 1)
    weighted = None
    for d in range(depth, -1, -1):
        own = _kt(*_nodes(counts[d].astype(np.float64)))
        if d == depth:
            weighted = own
            continue
        below = np.zeros_like(own)
        np.add.at(below, parent_at[d + 1], weighted)
        rest = counts[d].copy()
        np.subtract.at(rest, parent_at[d + 1], counts[d + 1])
        other[d] = np.maximum(rest, 0)
        below += _kt(*_nodes(other[d].astype(np.float64)))
        share[d] = (1 / (1 + np.exp(np.clip(below - own, -700, 700)))).astype(np.float32)
        weighted = np.logaddexp(own, below) - np.log(2)
    # Downwards: what the path so far predicts for bit 1, and the weight left for longer contexts.
    base = np.cumsum([0] + [len(k) for k in by_depth[:depth]])
    inner = int(base[depth])
    step = np.zeros((inner, 256), np.int32)
    logs, final = [], inner
    said, left = np.zeros((1, 255), np.float32), np.ones((1, 255), np.float32)
    for d in range(depth + 1):
        a, b = _nodes(counts[d])
        estimate = (b + 0.5) / (a + b + 1)
        if d:
            said, left = said[parent_at[d]], left[parent_at[d]]
        if d == depth:
            logs.append(_byte_logs(said + left * estimate))
            step[base[d - 1] + parent_at[d], by_depth[d] >> 8 * (d - 1)] = final + np.arange(len(by_depth[d]))
            break
        if d:
            step[base[d - 1] + parent_at[d], by_depth[d] >> 8 * (d - 1)] = base[d] + np.arange(len(by_depth[d]))
        said, left = said + left * share[d] * estimate, left * (1 - share[d])
        a, b = _nodes(other[d])
        logs.append(_byte_logs(said + left * (b + 0.5) / (a + b + 1)))
        step[base[d] : base[d + 1]] = final + np.arange(len(by_depth[d]))[:, None]  # until a kept child takes its byte
        final += len(by_depth[d])
    return Tree(step, np.concatenate(logs), depth)


def fit_tree(texts: DataFrame, max_contexts: int = MAX_CONTEXTS) -> Tree:
    """Counts all ``texts`` (binary column ``raw``) and keeps the most frequent contexts, closed under suffixes.

    A tree for one machine's memory; ``lm_score`` uses ``predict_pairs``, which keeps every context.
    """
    deep = stored(count_contexts(texts), "lm-contexts")
    depth = DEPTH
    levels = F.explode(
        F.array(*[F.struct(F.lit(d).alias("d"), F.col("context").bitwiseAND(F.lit((1 << 8 * d) - 1)).alias("c")) for d in range(depth + 1)])
    )
    tagged = F.col("x.c").bitwiseOR(F.shiftleft(F.col("x.d").cast("long"), 40))
    counts = (
        deep.withColumn("x", levels).groupBy(tagged.alias("context"), "byte").agg(F.sum("n").alias("n"))
    )
    counts = stored(counts, "lm-levels")
    totals = stored(counts.groupBy("context").agg(F.sum("n").alias("n")), "lm-totals")
    # Contexts by quarter octave of their counts; a suffix is never rarer than its context, so a bound on the
    # count keeps suffixes.
    grade = F.floor(4 * F.log2("n"))
    sizes = sorted(((r["g"], r["k"]) for r in totals.groupBy(grade.alias("g")).agg(F.count(F.lit(1)).alias("k")).collect()), reverse=True)
    kept, least = 0, 0
    for g, k in sizes:
        if kept and kept + k > max_contexts:
            break
        kept, least = kept + k, g
    chosen = totals.where(grade >= least).select("context")
    found = counts.join(F.broadcast(chosen), "context").toArrow()  # at most max_contexts * 256 rows
    context, byte, n = (found[c].to_numpy() for c in ("context", "byte", "n"))
    there = np.unique(context)
    by_depth = [there[there >> 40 == d] & ((1 << 40) - 1) for d in range(depth + 1)]
    if not len(there):
        context, byte, n = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        by_depth[0] = np.zeros(1, np.int64)
    return build_tree(context, byte, n, by_depth)
