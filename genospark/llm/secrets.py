"""Secret scans: patterns find what is surely a secret, a character network what looks like one.

A candidate is a run of 8 or more characters of the value alphabet that holds a digit or an equals sign, follows an
assignment mark, or overlaps a pattern's finding.  A small convolutional network, in numpy, reads every candidate with
the characters around it, window by window if it is long.  It is fitted on all distinct windows of candidates, which the
patterns label, one output for each pattern: parts of the windows are learned side by side and their networks averaged,
round by round.  A share of the windows is left aside for the calibration; each output's threshold is the most precise
that still finds ``MIN_RECALL`` of the labelled windows there.  Findings of the patterns always stay.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bound_batches, discard, shuffle_width, slices, stored

KINDS = ("assign", "access", "hex")
#: What the network adds.
ADDED = "network"
ASSIGN = re.compile(r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
ACCESS, HEX = re.compile("AKIA[A-Z0-9]+"), re.compile("[0-9a-f]+")
LEAST_VALUE, LEAST_ACCESS, LEAST_HEX = 8, 16, 32
_KEYWORDS = (b"passw", b"secret", b"token", b"api_key", b"apikey")
_RUN, _MARKED = re.compile(f"[A-Za-z0-9+/_.=-]{{{LEAST_VALUE},}}"), re.compile("[0-9=]")
_HEX_BYTES = bytes(104 if b in b"0123456789abcdef" else 32 for b in range(256))

#: A window: characters before, of the candidate, and after it.
BEFORE, INSIDE, AFTER = 24, 48, 8
WIDTH = BEFORE + INSIDE + AFTER
#: Distinct windows of a part of the fit, labelled and others each, at about most; of each set of kinds a part has
#: LEAST_SHOWN, or all there are, so rare ones are in several parts.  Every ASIDE-th is left for the calibration.
PART_WINDOWS, LEAST_SHOWN, ASIDE = 4096, 256, 4
#: Of the labelled windows left aside, the share that a threshold must find; and the share of what it finds there that
#: must be labelled, else that output adds nothing.
MIN_RECALL, MIN_PRECISION = 0.95, 0.9
_CODES, _DIM, _SPAN, _FILTERS, _HIDDEN = 97, 8, 5, 24, 16
#: Convolution outputs that see the characters before, inside and after.
_REGIONS = ((0, BEFORE - 2), (BEFORE - 2, BEFORE + INSIDE - 2), (BEFORE + INSIDE - 2, WIDTH - _SPAN + 1))
_EPOCHS, _STEPS, _BATCH, _RATE = 6, 800, 128, 3e-3
#: Windows that a worker holds at a time.
_HELD = 8192

Span = tuple[int, int, int]  # start, kind, end


def findings(text: str, raw: bytes | None = None) -> list[Span]:
    """The patterns' findings by start, then kind; ends are exclusive.  Per kind leftmost and without overlaps."""
    raw = text.encode("utf-8", "replace") if raw is None else raw
    low, out = raw.lower(), []
    if any(k in low for k in _KEYWORDS):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(1) - m.start(1) >= LEAST_VALUE]
    if b"AKIA" in raw:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST_ACCESS]
    if b"h" * LEAST_HEX in raw.translate(_HEX_BYTES):
        out += [(m.start(), 2, m.end()) for m in HEX.finditer(text) if m.end() - m.start() >= LEAST_HEX]
    return sorted(out)


def candidates(text: str, found: list[Span]) -> Iterator[tuple[int, int, set[int]]]:
    """(start, end, kinds that overlap it) of every candidate, by start."""
    at, open_ = 0, []
    for m in _RUN.finditer(text):
        start, end = m.span()
        while at < len(found) and found[at][0] < end:
            open_.append(found[at])
            at += 1
        if open_:
            open_ = [s for s in open_ if s[2] > start]
        kinds = {kind for _, kind, _ in open_}
        if kinds or _MARKED.search(m.group()) or text[max(start - 8, 0) : start].rstrip(" \"'").endswith((":", "=")):
            yield start, end, kinds


def windows(text: str, start: int, end: int) -> Iterator[str]:
    """A candidate's windows: INSIDE characters each, with what stands around them; what is missing is a NUL."""
    for at in range(start, end, INSIDE):
        to = min(at + INSIDE, end)
        yield text[max(at - BEFORE, 0) : at].rjust(BEFORE, "\0") + text[at:to].ljust(INSIDE, "\0") + text[to : to + AFTER].ljust(AFTER, "\0")


def encoded(found: list[str]) -> np.ndarray:
    """(windows, WIDTH) codes: 0 for what is missing, 1 to 95 for printable ASCII, 96 for all else."""
    points = np.frombuffer("".join(found).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(-1, WIDTH)
    return np.where(points == 0, 0, np.where((points >= 32) & (points < 127), points - 31, _CODES - 1)).astype(np.uint8)


class Network:
    """Embedding, convolution, the largest response before, inside and after the candidate, a hidden layer, a logit a kind."""

    def __init__(self, seed: int = 0):
        rng = np.random.default_rng(seed)
        shapes = {
            "embed": (_CODES, _DIM), "conv": (_DIM * _SPAN, _FILTERS), "conv_bias": (_FILTERS,), "dense": (_FILTERS * 3, _HIDDEN),
            "dense_bias": (_HIDDEN,), "out": (_HIDDEN, len(KINDS)), "out_bias": (len(KINDS),),
        }
        scale = lambda n, s: 0.0 if n.endswith("bias") else 0.5 if n == "embed" else np.sqrt(2 / s[0])
        self.p = {n: (rng.normal(size=s) * scale(n, s)).astype(np.float32) for n, s in shapes.items()}

    def _forward(self, x: np.ndarray) -> tuple[np.ndarray, ...]:
        p = self.p
        seen = np.lib.stride_tricks.sliding_window_view(p["embed"][x], _SPAN, axis=1)
        columns = seen.reshape(len(x), -1, _DIM * _SPAN)
        response = np.maximum(columns @ p["conv"] + p["conv_bias"], 0)
        pooled = np.concatenate([response[:, a:b].max(1) for a, b in _REGIONS], 1)
        hidden = np.maximum(pooled @ p["dense"] + p["dense_bias"], 0)
        return columns, response, pooled, hidden, hidden @ p["out"] + p["out_bias"]

    def logits(self, x: np.ndarray, step: int = 512) -> np.ndarray:
        return np.concatenate([self._forward(x[i : i + step])[-1] for i in range(0, len(x), step)] or [np.zeros((0, len(KINDS)), np.float32)])

    def gradients(self, x: np.ndarray, y: np.ndarray, weigh: np.ndarray) -> dict[str, np.ndarray]:
        """Those of the weighted logistic loss, averaged over the rows."""
        p = self.p
        columns, response, pooled, hidden, logit = self._forward(x)
        d = weigh * (1 / (1 + np.exp(-np.clip(logit, -40, 40))) - y) / len(x)
        g = {"out": hidden.T @ d, "out_bias": d.sum(0)}
        d = (d @ p["out"].T) * (hidden > 0)
        g |= {"dense": pooled.T @ d, "dense_bias": d.sum(0)}
        d = (d @ p["dense"].T) * (pooled > 0)
        back = np.zeros_like(response)
        rows, filters = np.arange(len(x))[:, None], np.arange(_FILTERS)[None, :]
        for k, (a, b) in enumerate(_REGIONS):
            back[rows, a + response[:, a:b].argmax(1), filters] += d[:, k * _FILTERS : (k + 1) * _FILTERS]
        flat = back.reshape(-1, _FILTERS)
        g |= {"conv": columns.reshape(-1, _DIM * _SPAN).T @ flat, "conv_bias": flat.sum(0)}
        onward = (back @ p["conv"].T).reshape(len(x), -1, _DIM, _SPAN)
        embed = np.zeros((_CODES, _DIM))
        for k in range(_SPAN):
            codes = x[:, k : k + onward.shape[1]].reshape(-1)
            for c in range(_DIM):
                embed[:, c] += np.bincount(codes, onward[:, :, c, k].reshape(-1), _CODES)
        return g | {"embed": embed.astype(np.float32)}

    def learn(self, x: np.ndarray, y: np.ndarray, epochs: int, state: State, rng: np.random.Generator) -> State:
        """Adam over shuffled batches, from ``state`` on; findings and others weigh the same for each kind."""
        share = y.mean(0).clip(1e-6, 1 - 1e-6)
        weigh = np.where(y > 0, 0.5 / share, 0.5 / (1 - share)).astype(np.float32)
        self.p, m, v, t = dict(state.p), dict(state.m), dict(state.v), state.t
        for _ in range(epochs):
            order = rng.permutation(len(x))
            for at in range(0, len(x), _BATCH):
                rows, t = order[at : at + _BATCH], t + 1
                for n, g in self.gradients(x[rows], y[rows], weigh[rows]).items():
                    m[n] = 0.9 * m[n] + 0.1 * g
                    v[n] = 0.999 * v[n] + 0.001 * g * g
                    self.p[n] = self.p[n] - (_RATE * (m[n] / (1 - 0.9**t)) / (np.sqrt(v[n] / (1 - 0.999**t)) + 1e-8)).astype(np.float32)
        return State(self.p, m, v, t)


@dataclass
class State:
    """A network's parameters, Adam's moments of them and its steps so far."""

    p: dict[str, np.ndarray]
    m: dict[str, np.ndarray]
    v: dict[str, np.ndarray]
    t: int

    @classmethod
    def of(cls, network: Network) -> State:
        return cls(dict(network.p), *({n: np.zeros_like(w) for n, w in network.p.items()} for _ in range(2)), 0)

    def flat(self) -> np.ndarray:
        return np.concatenate([d[n].reshape(-1) for d in (self.p, self.m, self.v) for n in self.p]).astype(np.float64)

    def filled(self, flat: np.ndarray, t: int) -> State:
        """One of these shapes with the numbers of ``flat``."""
        at, made = 0, []
        for d in (self.p, self.m, self.v):
            made.append({})
            for n, w in d.items():
                made[-1][n] = flat[at : at + w.size].reshape(w.shape).astype(np.float32)
                at += w.size
        return State(*made, t)


@dataclass
class Model:
    """A fitted network; a kind's calibrated probability is that of slope * logit + offset, its threshold above 1 if it adds
    nothing."""

    network: Network
    slope: np.ndarray
    offset: np.ndarray
    threshold: np.ndarray

    def probability(self, x: np.ndarray) -> np.ndarray:
        return _probability(self.network.logits(x), self.slope, self.offset)


def _probability(logit: np.ndarray, slope: np.ndarray, offset: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(slope * logit + offset, -40, 40)))


def _bits(kinds: np.ndarray) -> np.ndarray:
    return ((kinds.astype(np.int64)[:, None] >> np.arange(len(KINDS))) & 1).astype(np.float32)


def shown(rows: list[tuple[str, int]]) -> list[tuple[str, int]]:
    """What a part learns of its (window, bits of the kinds that found it).

    Findings are also shown with what stands around other candidates, so in upper case, and so cut short: the value itself
    counts.
    """
    others = [w for w, k in rows if not k]
    own = [(w, k) for w, k in rows if k]
    value = slice(BEFORE, BEFORE + INSIDE)
    elsewhere = [others[i % len(others)] for i in range(len(own))] if others else [w for w, _ in own]
    moved = [(o[:BEFORE] + w[value] + o[BEFORE + INSIDE :], k) for o, (w, k) in zip(elsewhere, own, strict=True)]
    upper = [(w[:BEFORE] + "".join(c.upper() if c.isascii() else c for c in w[value]) + w[BEFORE + INSIDE :], k) for w, k in moved]
    short = [(w[:BEFORE] + w[value].rstrip("\0")[: INSIDE * 2 // 3 - i % 8].ljust(INSIDE, "\0") + w[BEFORE + INSIDE :], k) for i, (w, k) in enumerate(moved)]
    return [*own, *moved, *upper, *short, *((w, 0) for w in others)]


def _text(raw: bytes | None) -> tuple[str, bytes]:
    raw = raw or b""
    return raw.decode("utf-8", "replace"), raw


def labelled_windows(docs: DataFrame) -> DataFrame:
    """(window, kinds): the distinct windows of all candidates, with the bits of the kinds whose findings they overlap."""
    bound_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: dict[str, int] = {}

        def told() -> pa.RecordBatch:
            out = pa.record_batch([pa.array(list(made), pa.string()), pa.array(list(made.values()), pa.int32())], names=["window", "kinds"])
            made.clear()
            return out

        for batch in slices(batches):
            for raw in batch.column("text").cast(pa.binary()).to_pylist():
                text, raw = _text(raw)
                for start, end, kinds in candidates(text, findings(text, raw)):
                    bits = sum(1 << k for k in kinds)
                    for w in windows(text, start, end):
                        made[w] = made.get(w, 0) | bits
                        if len(made) >= _HELD:
                            yield told()
        yield told()

    return docs.select("text").mapInArrow(run, "window string, kinds int").groupBy("window").agg(F.bit_or("kinds").alias("kinds"))


def _dealt(found: DataFrame, counts: dict[tuple[bool, int], int], parts: int) -> DataFrame:
    """A row per part: the codes and kinds of what it learns (x, y), and of its windows left aside (aside_x, aside_y)."""
    copies = F.lit(1)
    for (aside, kinds), n in counts.items():
        if not aside:
            times = min(parts, -(-parts * LEAST_SHOWN // n))
            copies = F.when(~F.col("aside") & (F.col("kinds") == kinds), times).otherwise(copies)
    first = F.pmod(F.xxhash64("window"), F.lit(parts))
    part = F.explode(F.transform(F.sequence(F.lit(0), copies - 1), lambda i: F.pmod(first + i, F.lit(parts)).cast("int")))

    def packed(table: pa.Table) -> pa.Table:
        rows = zip(*(table[c].to_pylist() for c in ("window", "kinds", "aside")), strict=True)
        rows = sorted(rows, key=lambda r: (zlib.crc32(r[0].encode("utf-8", "surrogatepass")), r[0]))
        out = {"part": pa.array(table["part"].to_pylist()[:1], pa.int32())}
        for name, some in (("", shown([r[:2] for r in rows if not r[2]])), ("aside_", [r[:2] for r in rows if r[2]])):
            out[f"{name}x"] = pa.array([encoded([w for w, _ in some]).tobytes()], pa.binary())
            out[f"{name}y"] = pa.array([np.array([k for _, k in some], np.uint8).tobytes()], pa.binary())
        return pa.table(out)

    rows = found.select("window", "kinds", "aside", part.alias("part")).repartition(parts, "part")
    return stored(rows.groupBy("part").applyInArrow(packed, "part int, x binary, y binary, aside_x binary, aside_y binary"), "secret-parts")


def _learned(dealt: DataFrame, parts: int, epochs: int, seed: int) -> Network:
    """All parts learn from the same network, which then becomes the average of theirs; one part learns in one round."""
    network = Network(seed)
    state, rounds = State.of(network), 1 if parts == 1 else _EPOCHS
    for turn in range(rounds):
        now = state

        def run(batches: Iterator[pa.RecordBatch], now: State = now, turn: int = turn) -> Iterator[pa.RecordBatch]:
            total, n, steps = 0.0, 0, 0
            for batch in slices(batches, 1):
                part, x, y = (batch.column(c)[0].as_py() for c in ("part", "x", "y"))
                if x:
                    x, y = np.frombuffer(x, np.uint8).reshape(-1, WIDTH), _bits(np.frombuffer(y, np.uint8))
                    done = Network(seed).learn(x, y, -(-epochs // rounds), now, np.random.default_rng([seed, turn, part]))
                    total, n, steps = total + done.flat(), n + 1, max(steps, done.t)
            if n:
                yield pa.record_batch([pa.array([total.tobytes()], pa.binary()), pa.array([n]), pa.array([steps])], names=["total", "n", "steps"])

        # A row per task: the sum of its parts' networks.
        told = dealt.select("part", "x", "y").mapInArrow(run, "total binary, n long, steps long").collect()
        total = np.sum([np.frombuffer(r["total"]) for r in told], axis=0)
        state = state.filled(total / sum(r["n"] for r in told), max(r["steps"] for r in told))
    network.p = state.p
    return network


def _calibrated(dealt: DataFrame, network: Network, ones: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Platt's slopes and offsets by Newton steps, and thresholds, from all windows left aside, ``n`` of which ``ones`` are
    labelled.

    A threshold is, of those that find MIN_RECALL of the labelled, the most precise, and of equals the one nearest to a
    half; above 1 if that is under MIN_PRECISION or if only one sort is there.
    """
    kinds = len(KINDS)
    slope, offset, threshold = np.ones(kinds), np.zeros(kinds), np.full(kinds, 2.0)
    both = (ones > 0) & (ones < n)
    if not both.any():
        return slope, offset, threshold

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            logit = network.logits(np.frombuffer(batch.column("aside_x")[0].as_py(), np.uint8).reshape(-1, WIDTH))
            yield pa.record_batch([batch.column("part"), pa.array([logit.astype(np.float64).tobytes()], pa.binary()), batch.column("aside_y")], names=["part", "logit", "y"])

    logits = stored(dealt.select("part", "aside_x", "aside_y").mapInArrow(read, "part int, logit binary, y binary"), "secret-logits")

    def of(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        return np.frombuffer(batch.column("logit")[0].as_py()).reshape(-1, kinds), _bits(np.frombuffer(batch.column("y")[0].as_py(), np.uint8))

    low, high = 1 / (n - ones + 2), (ones + 1) / (ones + 2)
    for _ in range(50):

        def sums(batches: Iterator[pa.RecordBatch], slope: np.ndarray = slope, offset: np.ndarray = offset) -> Iterator[pa.RecordBatch]:
            for batch in slices(batches, 1):
                logit, y = of(batch)
                p = _probability(logit, slope, offset)
                w, e = np.maximum(p * (1 - p), 1e-9), p - np.where(y > 0, high, low)
                found = np.stack([(w * logit * logit).sum(0), (w * logit).sum(0), w.sum(0), (e * logit).sum(0), e.sum(0)])
                yield pa.record_batch([batch.column("part"), pa.array([found.tobytes()], pa.binary())], names=["part", "sums"])

        told = sorted(logits.mapInArrow(sums, "part int, sums binary").collect(), key=lambda r: r["part"])
        of_all = np.sum([np.frombuffer(r["sums"]).reshape(5, kinds) for r in told], axis=0)
        steps = np.zeros((2, kinds))
        for k in np.flatnonzero(both):
            ll, l1, ww, el, ee = of_all[:, k]
            steps[:, k] = np.linalg.solve([[ll + 1e-3, l1], [l1, ww + 1e-3]], [el, ee]).clip(-1, 1)
        slope, offset = slope - steps[0], offset - steps[1]
        if np.abs(steps).max() < 1e-8:
            break

    def tallied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            logit, y = of(batch)
            p = _probability(logit, slope, offset)
            for k in np.flatnonzero(both):
                value, at = np.unique(p[:, k], return_inverse=True)
                columns = [np.full(len(value), k), value, np.bincount(at, minlength=len(value)), np.bincount(at, y[:, k], len(value)).astype(np.int64)]
                yield pa.record_batch([pa.array(c) for c in columns], names=["kind", "p", "n", "hits"])

    # What is found from each probability on: within ranges of them, and by a row per range what stands before it.
    order, width = [F.col("kind"), F.desc("p")], shuffle_width(dealt.sparkSession)
    tally = logits.mapInArrow(tallied, "kind long, p double, n long, hits long").groupBy("kind", "p").agg(F.sum("n").alias("n"), F.sum("hits").alias("hits"))
    ranged = stored(tally.repartitionByRange(width, *order).withColumn("range", F.spark_partition_id()), "secret-ranges")
    before = Window.partitionBy("kind").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    bases = ranged.groupBy("kind", "range").agg(F.sum("n").alias("n"), F.sum("hits").alias("hits"))
    bases = bases.select("kind", "range", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"{c}_before") for c in ("n", "hits")])
    upto = Window.partitionBy("kind", "range").orderBy(F.desc("p")).rowsBetween(Window.unboundedPreceding, 0)
    up = ranged.select("kind", "range", "p", *[F.sum(c).over(upto).alias(c) for c in ("n", "hits")]).join(F.broadcast(bases), ["kind", "range"])
    up = up.select("kind", "p", (F.col("n") + F.col("n_before")).alias("n"), (F.col("hits") + F.col("hits_before")).alias("hits"))
    needed = F.element_at(F.array(*[F.lit(float(x)) for x in MIN_RECALL * ones]), (F.col("kind") + 1).cast("int"))
    enough = up.where(F.col("hits") >= needed).withColumn("precision", F.col("hits") / F.col("n"))
    best = enough.groupBy("kind", "precision").agg(F.max("p").alias("first"), F.min("p").alias("end"))
    best = best.groupBy("kind").agg(F.max_by(F.struct("precision", "first", "end"), "precision").alias("best")).select("kind", "best.*")
    below = ranged.join(F.broadcast(best), "kind").groupBy("kind", "precision", "first", "end").agg(F.max(F.when(F.col("p") < F.col("end"), F.col("p"))).alias("low"))
    for r in below.collect():
        if r["precision"] >= MIN_PRECISION:
            threshold[r["kind"]] = np.clip(0.5, ((r["low"] or 0.0) + r["end"]) / 2, r["first"])
    discard(logits, ranged)
    return slope, offset, threshold


def fit(docs: DataFrame, part_windows: int = PART_WINDOWS, seed: int = 0) -> Model | None:
    """A model from all distinct windows; None where labelled ones or others are lacking.

    Parts have about ``part_windows`` labelled windows and as many others; a part's networks and sums are all that
    reaches the driver.
    """
    aside = F.expr(f"crc32(cast(window as binary)) div 7 % {ASIDE} = 0")
    found = stored(labelled_windows(docs).withColumn("aside", aside), "secret-windows")
    counts = {(r["aside"], r["kinds"]): r["count"] for r in found.groupBy("aside", "kinds").count().collect()}
    own = sum(n for (a, k), n in counts.items() if k and not a)
    others = counts.get((False, 0), 0)
    if not own or not others:
        discard(found)
        return None
    parts = -(-max(own, others) // part_windows)
    dealt = _dealt(found, counts, parts)
    # Findings are shown in four ways.
    each = sum(min(n * parts, max(n, parts * LEAST_SHOWN)) * (4 if k else 1) for (a, k), n in counts.items() if not a) // parts
    network = _learned(dealt, parts, max(_EPOCHS, -(-_STEPS * _BATCH // max(each, _BATCH))), seed)
    ones = np.array([sum(n for (a, k), n in counts.items() if a and k >> b & 1) for b in range(len(KINDS))])
    model = Model(network, *_calibrated(dealt, network, ones, sum(n for (a, _), n in counts.items() if a)))
    discard(found, dealt)
    return model


def scan(docs: DataFrame, model: Model | None, text_col: str = "text", redact: str | None = None) -> DataFrame:
    """``docs`` without the text, with ``spans``: (kind, start, end, probability) by start, then kind, those of the network last.

    Places are code points, ends exclusive.  A pattern's finding has probability 1; a candidate that overlaps none is
    added if one of its windows reaches the threshold of some kind.  With ``redact``, ``redacted`` is the text with every
    span replaced by it.  Null text is empty and has no spans; texts are read whole, however long; repeated rows are
    scanned alike; other columns pass through and columns called as the new ones are replaced.  Without a model (no
    labelled candidates, an empty table) the patterns' findings are all.
    """
    bound_batches(docs.sparkSession)
    docs = docs.drop("spans", "redacted")
    told = docs.sparkSession.sparkContext.broadcast(model)
    names = [c for c in docs.columns if c != text_col]
    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in docs.schema if f.name in names)
    kinds = [*KINDS, ADDED]
    span = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("probability", pa.float64())])

    def looked_up(texts: list[tuple[str, bytes]]) -> list[list[tuple[int, int, int, float]]]:
        model = told.value
        out, asked, place = [], [], []
        best: dict[tuple[int, int, int], float] = {}

        def ask() -> None:
            p = model.probability(encoded(asked))
            for i in np.flatnonzero((p >= model.threshold).any(1)):
                sure = float(p[i][p[i] >= model.threshold].max())
                best[place[i]] = max(best.get(place[i], 0.0), sure)
            asked.clear()
            place.clear()

        for at, (text, raw) in enumerate(texts):
            found = findings(text, raw)
            out.append([(start, kind, end, 1.0) for start, kind, end in found])
            for start, end, over in candidates(text, found) if model else ():
                for window in windows(text, start, end) if not over else ():
                    asked.append(window)
                    place.append((at, start, end))
                    if len(asked) >= _HELD:
                        ask()
        if asked:
            ask()
        for (at, start, end), sure in best.items():
            out[at].append((start, len(KINDS), end, sure))
        return [sorted(s) for s in out]

    def covered(text: str, spans: list[tuple[int, int, int, float]]) -> str:
        parts, at = [], 0
        for start, _, end, _ in spans:
            if start >= at:
                parts += [text[at:start], redact]
            at = max(at, end)
        return "".join([*parts, text[at:]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = [_text(t) for t in batch.column(text_col).cast(pa.binary()).to_pylist()]
            found = looked_up(texts)
            rows = [[{"kind": kinds[k], "start": a, "end": b, "probability": p} for a, k, b, p in spans] for spans in found]
            made = [pa.array(rows, pa.list_(span))]
            if redact is not None:
                made.append(pa.array([covered(t, s) for (t, _), s in zip(texts, found, strict=True)], pa.string()))
            yield pa.record_batch([*[batch.column(c) for c in names], *made], names=[*names, "spans", *["redacted"] * (redact is not None)])

    more = ", redacted string" if redact is not None else ""
    return docs.mapInArrow(run, f"{schema}spans array<struct<kind: string, start: bigint, end: bigint, probability: double>>{more}")


def secret_scan(docs: DataFrame, part_windows: int = PART_WINDOWS, redact: str | None = None) -> DataFrame:
    """Fits on the documents' own labelled candidates and scans all of them: see ``scan``."""
    return scan(docs, fit(docs, part_windows), redact=redact)


def digests(found: DataFrame) -> DataFrame:
    """``spans`` as text (kind:start:end, comma-joined), the numbers of the patterns' findings and their SHA-256."""
    written = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    of = lambda kind: F.filter("spans", lambda s: s["kind"] == kind)
    base = F.filter("spans", lambda s: s["kind"] != ADDED)
    return found.withColumns(
        {f"n_{k}": F.size(of(k)).cast("long") for k in KINDS} | {"base_sha256": F.sha2(written(base).cast("binary"), 256), "spans": written(F.col("spans"))}
    )
