"""LM scoring by context-tree weighting over bytes, beside an add-one unigram score of words.

A byte is eight binary decisions; each decision at each context depth has a Krichevsky-Trofimov estimator, and the
context tree mixes the estimates of all depths.  Counts of (context, byte) come from all training texts and are summed
by Spark, and every context of them has its place in the tree.  Subtrees below a suffix of three bytes are weighted
each in one group; the driver holds the contexts of up to two bytes only.  Pairs that scoring asks for are in the tree
with a count of 0 where training lacks them, so each position finds its log probability in one table: the pairs met most
are broadcast, the rest are counted by document and joined.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, id_hash, shuffle_width, slices, stored

#: Bytes of context at most.
DEPTH = 5
#: Bytes of the suffix whose subtree is weighted in one group; shorter contexts are the driver's.
CUT = 3
#: The pairs of context and byte met most, whose predictions are broadcast; all others meet theirs in a join.
HOT_PAIRS = 1 << 20
#: The most frequent words, whose counts are broadcast; all other words meet their counts in a join.
HOT_WORDS = 1 << 17
#: Bits of a context and its byte, which leave room for the number of one of 256 texts in 64 bits.
_PAIR_BITS = np.uint64(8 * (DEPTH + 1))
END = 0xFF  # ends a text; UTF-8 has no such byte
#: Pairs and words that a counting worker holds at most before it sends them on, and words that a scoring one remembers.
_FLUSH, _HELD_WORDS, _SEEN_WORDS = 1_000_000, 200_000, 150_000


#: Bytes of text whose positions are worked on at a time; longer texts come in several segments.
SEGMENT = 2 << 20


def _segments(lows: list[bytes], depth: int = DEPTH) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(context << 8 | byte) of the coded positions of all texts, END included, and the text of each: some SEGMENT
    positions at a time, so memory doesn't follow the longest text."""
    held, rows, size = [], [], 0

    def out() -> tuple[np.ndarray, np.ndarray]:
        data = np.frombuffer(b"".join(held), np.uint8)
        sizes = np.fromiter(map(len, held), np.int64, len(held))
        code = _contexts(data, np.cumsum(sizes) - sizes + depth, depth)
        return code, np.repeat(np.array(rows), sizes - depth)

    for row, text in enumerate(lows):
        for at in range(0, len(text) + 1, SEGMENT):
            before = text[max(at - depth, 0) : at].rjust(depth, b"\0")
            part = text[at : at + SEGMENT]
            held.append(before + part + (b"\xff" if at + SEGMENT > len(text) else b""))
            rows.append(row)
            size += len(part)
            if size >= SEGMENT:
                yield out()
                held, rows, size = [], [], 0
    if held:
        yield out()


def _codes(texts: list[bytes], depth: int = DEPTH) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts with ``depth`` zeros before and END after each, and where each text's bytes start."""
    pad = bytes(depth)
    data = np.frombuffer(b"".join(x for t in texts for x in (pad, t, b"\xff")), np.uint8)
    sizes = np.array([len(t) + depth + 1 for t in texts], np.int64)
    return data, np.cumsum(sizes) - sizes + depth


def _contexts(data: np.ndarray, starts: np.ndarray, depth: int = DEPTH) -> np.ndarray:
    """(context << 8 | byte) of each coded position; the newest byte of the context is its lowest."""
    wide = data.astype(np.uint64)
    code = np.zeros(len(data) - depth, np.uint64)
    for back in range(depth, -1, -1):
        code = (code << np.uint64(8)) | wide[depth - back : len(data) - back]
    coded = np.ones(len(data), bool)
    for back in range(1, depth + 1):
        coded[starts - back] = False
    return code[coded[depth:]]


def count_texts(texts: DataFrame) -> DataFrame:
    """(is_word, key long, k long, n long) over all texts in column ``raw`` (binary), in one pass.

    A key is context << 8 | byte, or the 64-bit hash of a word; ``k`` counts its places in texts to score (``ask``,
    pairs only), ``n`` those in training texts (``learn``).
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        words: Counter = Counter()

        def total() -> tuple[np.ndarray, ...]:
            code, k, n = (np.concatenate(c) for c in zip(*held, strict=True))
            unique, at = np.unique(code, return_inverse=True)
            return unique, *(np.bincount(at, x, len(unique)).astype(np.int64) for x in (k, n))

        def row(is_word: bool, *columns: np.ndarray) -> pa.RecordBatch:
            made = [pa.array(np.full(len(columns[0]), is_word)), *[pa.array(c.astype(np.int64)) for c in columns]]
            return pa.record_batch(made, names=["is_word", "key", "k", "n"])

        def all_words() -> pa.RecordBatch:
            keys = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words)).view(np.int64)
            return row(True, keys, np.zeros(len(words)), np.fromiter(words.values(), np.int64, len(words)))

        for batch in slices(batches):
            lows = [t.lower() for t in batch.column("raw").to_pylist()]
            ask, learn = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("ask", "learn"))
            for low, use in zip(lows, learn, strict=True):
                if use:
                    words.update(_words(low))
                    if len(words) > _HELD_WORDS:
                        yield all_words()
                        words.clear()
            for code, at in _segments(lows):
                for use in {*zip(ask.tolist(), learn.tolist(), strict=True)}:
                    own = code[((ask == use[0]) & (learn == use[1]))[at]]
                    own, times = np.unique(own, return_counts=True)
                    held.append((own, times * use[0], times * use[1]))
                    size += len(own)
                if size > _FLUSH:
                    held = [total()]
                    size = len(held[0][0])
                    if size > _FLUSH // 2:
                        yield row(False, *held[0])
                        held, size = [], 0
        if held:
            yield row(False, *total())
        yield all_words()

    found = texts.mapInArrow(count, "is_word boolean, key long, k long, n long")
    return found.groupBy("is_word", "key").agg(F.sum("k").alias("k"), F.sum("n").alias("n"))


def count_pairs(texts: DataFrame) -> DataFrame:
    """(pair, k, n) of ``count_texts``."""
    return count_texts(texts).where("not is_word").select(F.col("key").alias("pair"), "k", "n")


def _words(low: bytes) -> Iterable[bytes]:
    """Runs of anything but ASCII white space; of a very long text one at a time."""
    return low.split() if len(low) < 8 * SEGMENT else (m[0] for m in re.finditer(rb"\S+", low))


def _log_gamma(x: np.ndarray) -> np.ndarray:
    """Stirling's series after a shift by 8; absolute error below 1e-10 for x >= 0.5."""
    shift = np.ones_like(x)
    for k in range(8):
        shift *= x + k
    z = x + 8
    return (z - 0.5) * np.log(z) - z + 0.9189385332046727 + 1 / (12 * z) - 1 / (360 * z**3) + 1 / (1260 * z**5) - np.log(shift)


def _kt(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Log of the Krichevsky-Trofimov block probability of a zeros and b ones."""
    return _log_gamma(a + 0.5) + _log_gamma(b + 0.5) - _log_gamma(a + b + 1) - np.log(np.pi)


def _subtree_groups(batches: Iterator[pa.RecordBatch], least: int = 1 << 16) -> Iterator[list[np.ndarray]]:
    """pair, k and n of whole groups (pairs that share CUT bytes of suffix), from batches in order of the suffix."""
    held, size, due = [], 0, least
    for batch in batches:
        held.append([batch.column(c).to_numpy(zero_copy_only=False) for c in ("pair", "k", "n")])
        size += batch.num_rows
        if size >= due:
            whole = [np.concatenate(c) for c in zip(*held, strict=True)]
            suffix = whole[0] >> 8 & (1 << 8 * CUT) - 1
            cut = int(np.argmax(suffix == suffix[-1]))
            if cut:
                yield [c[:cut] for c in whole]
            held, size = [[c[cut:] for c in whole]], size - cut
            due = max(least, 2 * size)
    if size:
        yield [np.concatenate(c) for c in zip(*held, strict=True)]


class _Level:
    """The bit nodes of one level of the byte's tree, at the contexts of CUT to DEPTH bytes of some groups.

    By depth: ``node_of`` each (context, byte), ``parent`` of each node one depth up, counts ``a`` and ``b`` of bits 0
    and 1, and ``share``, the weight of the context's own estimate.  ``weighted`` is that of depth CUT, ``node`` its
    key: context << 8 | place in heap order.
    """

    def __init__(self, level: int, keys: list[np.ndarray], up: list[np.ndarray], n: list[np.ndarray]):
        self.node_of, self.parent, self.a, self.b, self.share = ([None] * (DEPTH + 1) for _ in range(5))
        self.bit = keys[DEPTH] >> 7 - level & 1
        for d in range(CUT, DEPTH + 1):
            prefix = keys[d] >> 8 - level
            new = np.concatenate([[True], prefix[1:] != prefix[:-1]])
            first = np.flatnonzero(new)
            self.node_of[d] = np.cumsum(new) - 1
            self.b[d] = np.add.reduceat(n[d] * (keys[d] >> 7 - level & 1), first).astype(np.float64)
            self.a[d] = np.add.reduceat(n[d], first) - self.b[d]
            if d > CUT:
                self.parent[d] = self.node_of[d - 1][up[d][first]]
            else:
                self.node = (keys[d][first] & ~255) | 1 << level | (keys[d][first] & 255) >> 8 - level
        self.weighted = _kt(self.a[DEPTH], self.b[DEPTH])
        for d in range(DEPTH - 1, CUT - 1, -1):
            below = np.bincount(self.parent[d + 1], self.weighted, len(self.a[d]))
            self.share[d], self.weighted = _weigh(_kt(self.a[d], self.b[d]), below)

    def logs(self, said: np.ndarray, left: np.ndarray) -> np.ndarray:
        """Log probability of each pair's bit, from what contexts shorter than CUT say and leave."""
        for d in range(CUT, DEPTH):
            said, left = said + left * self.share[d] * _estimate(self.a[d], self.b[d]), left * (1 - self.share[d])
            said, left = said[self.parent[d + 1]], left[self.parent[d + 1]]
        one = (said + left * _estimate(self.a[DEPTH], self.b[DEPTH]))[self.node_of[DEPTH]]
        return np.where(self.bit == 1, np.log(one), np.log1p(-one))


def _weigh(own: np.ndarray, below: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Weight of a context's own estimate and its weighted probability: half its own, half that of its branches."""
    return 1 / (1 + np.exp(np.clip(below - own, -700, 700))), np.logaddexp(own, below) - np.log(2)


def _estimate(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (b + 0.5) / (a + b + 1)


def _subtrees(pair: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, Iterator[_Level]]:
    """The order that sorts ``pair`` (distinct, whole groups), and the eight levels over the sorted pairs."""
    order = np.argsort(pair)
    keys, up, counts = ([None] * (DEPTH + 1) for _ in range(3))
    keys[DEPTH], counts[DEPTH] = pair[order], n[order]
    for d in range(DEPTH, CUT, -1):
        keys[d - 1], up[d] = np.unique(keys[d] & (1 << 8 * d) - 1, return_inverse=True)
        counts[d - 1] = np.bincount(up[d], counts[d], len(keys[d - 1])).astype(np.int64)
    return order, (_Level(level, keys, up, counts) for level in range(8))


def _crown(node: np.ndarray, a: np.ndarray, b: np.ndarray, below: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What contexts shorter than CUT say for bit 1 and leave to longer ones, at each ``node`` of CUT - 1 bytes."""
    ladder = []
    for d in range(CUT - 1, -1, -1):
        share, weighted = _weigh(_kt(a, b), below)
        parent = None
        if d:
            node, parent = np.unique(node & (1 << 8 * d) - 1, return_inverse=True)
        ladder.append((share, _estimate(a, b), parent))
        if d:
            a, b, below = (np.bincount(parent, x, len(node)) for x in (a, b, weighted))
    said, left = np.zeros(len(node)), np.ones(len(node))
    for share, estimate, parent in reversed(ladder):
        if parent is not None:
            said, left = said[parent], left[parent]
        said, left = said + left * share * estimate, left * (1 - share)
    return said, left


def predict_pairs(pairs: DataFrame) -> DataFrame:
    """(pair, k, log float): the natural log probability of each pair's byte after its context, from all ``pairs``."""
    suffix = F.shiftright("pair", 8).bitwiseAND(F.lit((1 << 8 * CUT) - 1))
    groups = pairs.repartition(shuffle_width(pairs.sparkSession), suffix).sortWithinPartitions(suffix)

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for pair, _, n in _subtree_groups(batches):
            for level in _subtrees(pair, n)[1]:
                node, at = np.unique(level.node & (1 << 8 * CUT) - 1, return_inverse=True)
                sums = [np.bincount(at, x, len(node)) for x in (level.a[CUT], level.b[CUT], level.weighted)]
                yield pa.record_batch([pa.array(c) for c in (node, *sums)], names=["node", "a", "b", "below"])

    # A row for each context of CUT - 1 bytes and bit node: 65,536 x 255 at most, whatever the input.
    crown = groups.mapInArrow(weigh, "node long, a double, b double, below double").groupBy("node")
    crown = crown.agg(*[F.sum(c).alias(c) for c in ("a", "b", "below")]).orderBy("node").toArrow()
    node = crown["node"].to_numpy()
    told = pairs.sparkSession.sparkContext.broadcast((node, *_crown(node, *(crown[c].to_numpy() for c in ("a", "b", "below")))))

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, said, left = told.value
        for pair, k, n in _subtree_groups(batches):
            order, levels = _subtrees(pair, n)
            logs = np.zeros(len(pair))
            for level in levels:
                at = np.searchsorted(node, level.node & (1 << 8 * CUT) - 1)
                logs += level.logs(said[at], left[at])
            columns = [pa.array(pair[order]), pa.array(k[order]), pa.array(logs.astype(np.float32))]
            yield pa.record_batch(columns, names=["pair", "k", "log"])

    return groups.mapInArrow(predict, "pair long, k long, log float")


class PairTable:
    """Pairs and their logs in open slots, those given first nearest to their first slot."""

    def __init__(self, pairs: np.ndarray, logs: np.ndarray):
        bits = max(4, int(2 * len(pairs) - 1).bit_length())
        self.shift, self.last = np.uint64(64 - bits), (1 << bits) - 1
        self.pairs, self.logs = np.full(1 << bits, -1, np.int64).view(np.uint64), np.zeros(1 << bits, np.float32)
        pairs = pairs.astype(np.uint64)
        at, rest = self._slot(pairs), np.arange(len(pairs))
        while len(rest):
            open_ = rest[self.pairs[at[rest]] == self.pairs.dtype.type(2**64 - 1)]
            slot, first = np.unique(at[open_], return_index=True)
            self.pairs[slot], self.logs[slot] = pairs[open_[first]], logs[open_[first]]
            rest = rest[self.pairs[at[rest]] != pairs[rest]]
            at[rest] = at[rest] + 1 & self.last

    def _slot(self, pairs: np.ndarray) -> np.ndarray:
        return (pairs * np.uint64(0x9E3779B97F4A7C15) >> self.shift).view(np.int64)

    def look(self, pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The log of each pair, 0 where the table lacks it, and the places of those that it lacks."""
        at = self._slot(pairs)
        logs, other = self.logs[at], np.flatnonzero(self.pairs[at] != pairs)
        at, lacking = at[other], []
        while len(other):
            logs[other] = 0
            empty = self.pairs[at] == np.uint64(2**64 - 1)
            lacking.append(other[empty])
            other, at = other[~empty], at[~empty] + 1 & self.last
            found = self.pairs[at] == pairs[other]
            logs[other[found]] = self.logs[at[found]]
            other, at = other[~found], at[~found]
        return logs, np.sort(np.concatenate(lacking)) if lacking else np.zeros(0, np.int64)


def _hot_pairs(predicted: DataFrame) -> PairTable:
    """The pairs met most, by eighth octaves of their places, as many whole ones as HOT_PAIRS holds."""
    grade = F.floor(8 * F.log2("k"))
    sizes = predicted.where("k > 0").groupBy(grade.alias("g")).agg(F.count(F.lit(1)).alias("m")).collect()
    kept, least = 0, None
    for g, m in sorted(((r["g"], r["m"]) for r in sizes), reverse=True):
        if kept + m > HOT_PAIRS:
            break
        kept, least = kept + m, g
    found = predicted.where("k > 0").where(grade >= least if least is not None else F.lit(False)).toArrow()
    order = np.argsort(-found["k"].to_numpy(), kind="stable")
    return PairTable(found["pair"].to_numpy()[order], found["log"].to_numpy()[order])


def lm_score(docs: DataFrame, training: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Scores ``docs`` by models learned from ``training`` (both with an id and a text).

    Returns doc_id, n_tokens, n_known, train_tokens, base_score, score (log10 probabilities) and code_length (bits
    a byte, the end included).  Null text is empty: its one token is the end.  Words meet their counts by a 64-bit
    hash.  Rows that repeat an id and a text are scored once and given back as often as they came.  Without training
    rows every token is unknown (N = V = 0, so each word and end scores log10(1 / 1)) and every bit costs one bit.
    Long texts are worked on by segments.  An empty table gives an empty result.
    """
    texts = _texts(docs, F.lit(True), F.lit(False), text_col).unionByName(_texts(training, F.lit(False), F.lit(True), text_col))
    return _scored(docs, training, texts, id_col, text_col)


def _texts(rows: DataFrame, ask: Column, learn: Column, text_col: str = "text") -> DataFrame:
    return rows.select(_raw(F.col(text_col)).alias("raw"), ask.alias("ask"), learn.alias("learn"))


def _scored(docs: DataFrame, training: DataFrame, texts: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``lm_score`` from ``texts`` that say which of them to learn from and which will be scored."""
    spark = docs.sparkSession
    bound_batches(spark)
    ends = training.count()
    counted = stored(count_texts(texts), "lm-counts")
    words = counted.where("is_word").select(F.col("key").alias("word"), "n")
    pairs_of = counted.where("not is_word").select(F.col("key").alias("pair"), "k", "n")
    facts = words.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("v")).first()
    n_train, vocabulary = facts["n"] + ends, facts["v"] + (ends > 0)
    unit = float(np.log10(n_train + vocabulary + 1))
    hot = words.orderBy(F.desc("n"), "word").limit(HOT_WORDS).toArrow()
    predicted = stored(predict_pairs(pairs_of), "lm-predicted")
    table = _hot_pairs(predicted)
    told = spark.sparkContext.broadcast((hot["word"].to_numpy().view(np.uint64), np.log10(hot["n"].to_numpy() + 1.0), table))
    end_log = float(np.log10(ends + 1))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot_words, hot_logs, table = told.value
        log_of = dict(zip(hot_words.tolist(), hot_logs.tolist(), strict=True))
        digest = xxhash.xxh3_64_intdigest
        seen: dict[bytes, tuple[int, float]] = {}
        for batch in slices(batches, 256, 1 << 20):
            ids, lows = batch.column("doc_id").to_pylist(), [t.lower() for t in batch.column("raw").to_pylist()]
            logs, lacking = np.zeros(len(lows)), []
            for code, at in _segments(lows):
                position_logs, cold = table.look(code)
                logs += np.bincount(at, position_logs, len(lows))
                lacking.append(np.unique(at[cold].astype(np.uint64) << _PAIR_BITS | code[cold], return_counts=True))
            cold, times = (np.concatenate(c) for c in zip(*lacking, strict=True))
            rare, row_of = [], []
            summary = []
            for at, text in enumerate(lows):
                tokens = Counter(_words(text))
                known, total = int(ends > 0), end_log
                for word, k in tokens.items():
                    entry = seen.get(word)
                    if entry is None:
                        if len(seen) > _SEEN_WORDS:
                            seen.clear()
                        h = digest(word)
                        entry = h, log_of.get(h, -1.0)
                        if len(word) <= 64:
                            seen[word] = entry
                    if entry[1] >= 0:
                        known += k
                        total += k * entry[1]
                    else:
                        rare.append((entry[0], k))
                        row_of.append(at)
                summary.append((tokens.total() + 1, known, total, float(logs[at]) / np.log(10), len(text) + 1))
            key = [xxhash.xxh3_64_intdigest(t) for t in lows]
            # One row for the document itself, under a key of its own, and one for each rare word and each cold pair.
            n_rare, n_cold = len(rare), len(cold)
            take = np.concatenate([np.array([*range(len(lows)), *row_of], np.int64), (cold >> _PAIR_BITS).astype(np.int64)])
            word = np.concatenate([np.array([*key, *[h for h, _ in rare]], np.uint64), cold & (np.uint64(1) << _PAIR_BITS) - np.uint64(1)]).view(np.int64)
            is_pair = np.arange(len(take)) >= len(lows) + n_rare
            columns = [
                pa.array(ids, pa.int64()).take(pa.array(take)), pa.array(np.array(key, np.uint64).view(np.int64)[take]), pa.array(word),
                pa.array(is_pair), pa.array([None] * len(lows) + [k for _, k in rare] + times.tolist(), pa.int64()),
                *[pa.array([s[i] for s in summary] + [None] * (n_rare + n_cold), kind) for i, kind in enumerate((pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.int64()))],
            ]
            yield pa.record_batch(columns, names=["doc_id", "text_key", "word", "is_pair", "k", "n_tokens", "known", "log_sum", "score", "n_bytes"])

    schema = "doc_id long, text_key long, word long, is_pair boolean, k long, n_tokens long, known long, log_sum double, score double, n_bytes long"
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), _raw(F.col(text_col)).alias("raw")).mapInArrow(score, schema)
    known = words.select("word", F.lit(False).alias("is_pair"), "n", F.lit(None).cast("float").alias("log"))
    pairs = predicted.where("k > 0").select(F.col("pair").alias("word"), F.lit(True).alias("is_pair"), F.lit(None).cast("long").alias("n"), "log")
    met = rows.join(known.unionByName(pairs), ["word", "is_pair"], "left")
    rare_known = F.when(F.col("k").isNotNull() & F.col("n").isNotNull(), F.col("k"))
    by_doc = met.groupBy("doc_id", "text_key").agg(
        F.count("n_tokens").alias("times"), F.max("n_tokens").alias("n_tokens"), F.max("known").alias("hot_known"),
        F.max("log_sum").alias("hot_sum"), F.max("score").alias("score"), F.max("n_bytes").alias("n_bytes"),
        F.coalesce(F.sum(F.col("k") * F.col("log").cast("double")) / np.log(10), F.lit(0.0)).alias("cold_score"),
        F.coalesce(F.sum(rare_known), F.lit(0)).alias("known"),
        F.coalesce(F.sum(rare_known * F.log10(F.col("n") + 1)), F.lit(0.0)).alias("rare_sum"),
    )
    out = by_doc.withColumn("score", F.col("score") + F.col("cold_score") / F.col("times")).select(
        "doc_id", "n_tokens",
        (F.col("hot_known") + (F.col("known") / F.col("times")).cast("long")).alias("n_known"),
        F.lit(n_train).cast("long").alias("train_tokens"),
        (F.col("hot_sum") + F.col("rare_sum") / F.col("times") - F.col("n_tokens") * unit).alias("base_score"),
        "score", (-F.col("score") * F.lit(float(np.log2(10))) / F.col("n_bytes")).alias("code_length"),
        F.explode(F.array_repeat(F.lit(0), F.col("times").cast("int"))).alias("_"),
    )
    return out.drop("_")


def _raw(text: Column) -> Column:
    """Bytes, whose ``lower`` in Python concerns A-Z alone."""
    return F.coalesce(text, F.lit("")).cast("binary")


def score_held_out(docs: DataFrame) -> DataFrame:
    """Learns from documents whose id's crc32 does not leave 2 modulo 7 and scores all; adds ``held_out``."""
    out_of = F.coalesce(F.pmod(id_hash(F.col("doc_id")), F.lit(7)) == 2, F.lit(False))
    scored = _scored(docs, docs.where(~out_of), _texts(docs, F.lit(True), ~out_of))
    return scored.select("doc_id", out_of.alias("held_out"), *[c for c in scored.columns if c != "doc_id"])
