"""Token ids in files of compressed blocks: an adaptive context-mixing range coder, vectorised over lanes.

A block holds whole documents and is coded on its own: its models start empty, and it carries its documents' ids, its
place and a checksum of all that.  Its token ids are cut into up to ``LANES`` equal runs that are coded side by side,
one id of each lane at a time, so a step is a few array operations.  Three models predict each id:

* order 2: the id that last followed this pair of ids, with a level of trust: how often in a row it came true;
* order 1: counts of all ids that followed this id so far;
* order 0: counts over the whole vocabulary.

An id is coded by the first of them that has it, so the mixture is ``wA [id = guess of order 2] + w1 P1(id) + w0 P0(id)``
in slots of their own.  The weights are learned: for each joint state of the guess's trust and of what order 1 has seen
(how often this id came, how often each of its followers), how often either coded an id so far.  Counts are taken over at
steps that grow by two thirds, which keeps this work in proportion to the block.  The mixture drives a carry-less range coder;
the decoder repeats the same steps, so it knows the same models and weights.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bound_batches, shuffle_width, slices, stored
from .tokens import PieceTokenizer

MAGIC = b"TIDB"
VERSION = 4
LANES = 8192
#: Ids after which a block is closed; a longer document makes a longer block.
BLOCK_IDS = 1 << 21
#: A lane's run at least, so that small blocks don't pay for many lanes.
LEAST_RUN = 64
TOTAL_BITS = 26  # the coder's frequencies add up to 2^26
ZERO_BITS = 20  # those of order 0 to 2^20; the mixture leaves order 0 that much at least, so each id has a slot
PAIR_BITS = 18  # slots of the order-2 table
TRUST = 16  # levels of trust of a guess; level 0 is that of no guess or of one that failed last
PLACE_BITS = 20  # slots of the encoder's table of places in order 1
LEVELS = 64  # of what order 1 has seen after an id; level 0 is nothing
SCALE_BITS = 16  # the counts after one id add up to 2^16 and one for each of these ids at most
_LEVEL_BITS = LEVELS.bit_length() - 1
_PART_BITS = 21  # of a start or a size of order 1, which are below 2^SCALE_BITS + 2^ZERO_BITS
_PART = (1 << _PART_BITS) - 1
_U = np.uint64
_TOTAL = 1 << TOTAL_BITS
_LOW32, _32 = _U((1 << 32) - 1), _U(32)


class Mixer:
    """The adaptive models that coder and decoder share; ``look`` predicts for all lanes, ``learn`` updates.

    Slots [0, a) are those of guess A, [a, a + b) those of order 1, the rest those of order 0.
    """

    def __init__(self, vocabulary: int, lanes: int, decodes: bool):
        self.vocabulary, self.decodes = vocabulary, decodes
        # The guess of order 2, as id * TRUST + trust.
        self.table2 = np.full(1 << PAIR_BITS, -TRUST, np.int32)
        self.seen = np.tile(np.array([[2.0], [0.5], [0.8]]), TRUST * LEVELS).T  # of each state: all, by A and by order 1
        self.last, self.before = (np.full(lanes, vocabulary, np.int32) for _ in range(2))
        self.at, self.counted = self.last.astype(np.intp), self.last  # the ids up to which pairs are counted
        self.counts, self.waiting, self.step, self.due = np.zeros(vocabulary, np.int64), [], 0, 1
        # Order 1: id before * vocabulary + id, ascending, and how often that was.
        self.pairs, self.times = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.kind = np.uint32 if (vocabulary + 1) ** 2 < 1 << 32 else np.int64  # holds a pair; narrow ones are sorted faster
        # A slot's place and, in its lowest bit, whether other pairs meet there.
        self.place_of = np.zeros(0 if decodes else 1 << PLACE_BITS, np.int32)
        # What the weights share, so that each id of order 1 and of order 0 has a slot beside them.
        self.room = _TOTAL - (1 << ZERO_BITS) - (1 << SCALE_BITS) - vocabulary - 1
        self._count()
        self._count_pairs()
        self._weigh()

    def _count(self) -> None:
        """Order 0 in 2^ZERO_BITS parts, one at least for each id."""
        if self.waiting:
            self.counts += np.bincount(np.concatenate(self.waiting), minlength=self.vocabulary)
        room = (1 << ZERO_BITS) - self.vocabulary
        self.size0 = 1 + (self.counts * (room / max(int(self.counts.sum()), 1))).astype(np.int64)
        self.size0[int(self.size0.argmax())] += (1 << ZERO_BITS) - int(self.size0.sum())
        self.start0 = np.cumsum(self.size0) - self.size0
        if self.decodes:
            self.id_at = np.repeat(np.arange(self.vocabulary, dtype=np.int32), self.size0)

    def _count_pairs(self) -> None:
        """Order 1: the parts of the ids that followed each id, one at least for each; those of one id that were over
        2^SCALE_BITS are scaled down to that."""
        if self.waiting:
            came = np.concatenate([self.counted, *self.waiting]).astype(self.kind)
            lanes, self.counted, self.waiting = len(self.counted), self.waiting[-1], []
            new = came[:-lanes] * self.kind(self.vocabulary) + came[lanes:]
            new.sort()
            upto = np.append(np.flatnonzero(new[1:] != new[:-1]), len(new) - 1)
            new, times = new.take(upto).astype(np.int64), np.diff(upto, prepend=-1)
            at = np.searchsorted(self.pairs, new)
            old = np.append(self.pairs, -1).take(at) == new
            again = np.flatnonzero(old)
            self.times[at.take(again)] += times.take(again)
            fresh = np.flatnonzero(~old)
            place = at.take(fresh) + np.arange(len(fresh))
            stays = np.ones(len(self.pairs) + len(fresh), bool)
            stays[place] = False
            stays = np.flatnonzero(stays)
            self.pairs, self.times = (_merged(c, stays, x.take(fresh), place) for c, x in ((self.pairs, new), (self.times, times)))
        context = self.pairs // self.vocabulary
        kinds = np.bincount(context, minlength=self.vocabulary + 1)
        bounds = np.cumsum(kinds)
        total = _sums(self.times, bounds)
        # A context's level: how often it was there, and how often each of its ids on average.
        spread = np.clip(np.frexp(total / np.maximum(kinds, 1))[1], 1, 4) - 1
        self.level1 = np.minimum(np.frexp(total)[1], LEVELS // 4 - 1).astype(np.int64) * 4 + spread
        size = self.times
        if total.max() > 1 << SCALE_BITS:
            all1 = np.repeat(total, kinds)
            size = np.where(all1 > 1 << SCALE_BITS, np.maximum(1, (size << SCALE_BITS) // all1), size)
            total = _sums(size, bounds)
        self.total1, self.base1 = total, np.cumsum(total) - total
        start = np.cumsum(size) - size - np.repeat(self.base1, kinds)
        # What is looked up together lies together.
        self.context1 = total << _LEVEL_BITS | self.level1
        self.part1 = start << _PART_BITS | size
        if self.decodes:
            self.part1 |= self.pairs - context * self.vocabulary << 2 * _PART_BITS
            self.place_at = np.repeat(np.arange(len(self.pairs), dtype=np.int32), size)
        else:
            slot, place = self._slot(self.pairs), np.arange(len(self.pairs), dtype=np.int32) << 1
            self.place_of[slot] = place
            self.place_of[slot[self.place_of.take(slot) >> 1 << 1 != place]] |= 1
            self.ended_pairs = np.append(self.pairs, -1)

    def _slot(self, pairs: np.ndarray) -> np.ndarray:
        return (pairs.view(_U) * _U(0x9E3779B97F4A7C15) >> _U(64 - PLACE_BITS)).view(np.int64)

    def places(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The places of ``ids`` in order 1, and whether they have one."""
        pairs = self.at * self.vocabulary + ids
        held = self.place_of.take(self._slot(pairs))
        place = (held >> 1).astype(np.intp)
        there = self.ended_pairs.take(place) == pairs
        # Pairs may meet in a slot; those that could be in it but are not are searched.
        at = np.flatnonzero((held & 1).astype(bool) & ~there)
        if len(at):
            searched = pairs.take(at)
            place[at] = found = np.searchsorted(self.pairs, searched)
            there[at] = self.ended_pairs.take(found) == searched
        return place, there

    def _weigh(self) -> None:
        seen = self.seen.T
        # One slot at least, however seldom a guess came true: it still may.
        self.weight_a, self.weight_b = 1 + (seen[1:] / seen[0] * (self.room - 2)).astype(np.int64)
        self.after_b = self.weight_b.copy()
        self.after_b[::LEVELS] = 0  # where order 1 has seen nothing

    def look(self) -> tuple[np.ndarray, ...]:
        """Guess A, its weight a, and b of order 1, whose parts add up to ``all1``; b is 0 after an id not seen so far."""
        self.pair = (self.before.view(np.uint32) * np.uint32(0x9E3779B1) + self.last.view(np.uint32) * np.uint32(0x85EBCA77)) >> np.uint32(32 - PAIR_BITS)
        self.pair = self.pair.astype(np.intp)
        two, one = self.table2.take(self.pair), self.context1.take(self.at)
        self.trust2, self.guess_a = two & (TRUST - 1), two >> 4
        self.all1 = one >> _LEVEL_BITS
        self.state = (self.trust2 << _LEVEL_BITS) + (one & (LEVELS - 1))
        return self.guess_a, self.weight_a.take(self.state), self.all1 + self.after_b.take(self.state)

    def slots0(self, ids: np.ndarray, guessed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the slots of ``ids`` by order 0 begin and how many they are, after those ``guessed``."""
        start, rest = self.start0.take(ids), _TOTAL - guessed
        below = start * rest >> ZERO_BITS
        return below + guessed, ((start + self.size0.take(ids)) * rest >> ZERO_BITS) - below

    def ids0(self, slot: np.ndarray, guessed: np.ndarray) -> np.ndarray:
        """The ids that have these slots."""
        inside = _parts((slot - guessed + 1 << ZERO_BITS) - 1, _TOTAL - guessed)
        return self.id_at.take(np.minimum(inside, (1 << ZERO_BITS) - 1))

    def slots1(self, part: np.ndarray, all1: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Likewise by order 1, of the ids that have these of its parts, in lanes with these weights."""
        start, size = part >> _PART_BITS & _PART, part & _PART
        below = _parts(start * b, all1)
        return below + a, _parts((start + size) * b, all1) - below

    def parts1(self, slot: np.ndarray, lane: np.ndarray, all1: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The parts in order 1 that have these slots, with their ids above them."""
        inside = _parts((slot - a + 1) * all1 - 1, b)
        return self.part1.take(self.place_at.take(self.base1.take(self.at.take(lane)) + inside))

    def learn(self, ids: np.ndarray, by: np.ndarray) -> None:
        """``ids`` (int32) are what came, ``by`` what coded them: 0 order 0, 1 guess A, 2 order 1."""
        states = TRUST * LEVELS
        came = np.bincount(self.state + by * np.int64(states), minlength=3 * states).reshape(3, states)
        came[0] += came[1] + came[2]
        self.seen += came.T
        self._weigh()
        self.table2[self.pair] = (ids << 4) + np.minimum(self.trust2 + 1, TRUST - 1) * (by == 1)
        self.waiting.append(ids)
        self.before, self.last, self.at = self.last, ids, ids.astype(np.intp)
        self.step += 1
        if self.step == self.due:
            self._count()
            self._count_pairs()
            self.due += 1 + 2 * self.step // 3  # the last time is at step 171 of the 256 of a usual block


def _merged(x: np.ndarray, to_x: np.ndarray, y: np.ndarray, to_y: np.ndarray) -> np.ndarray:
    out = np.empty(len(x) + len(y), x.dtype)
    out[to_x], out[to_y] = x, y
    return out


def _sums(x: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of the runs of ``x`` that end before ``bounds``."""
    upto = np.append(0, np.cumsum(x)).take(bounds)
    return np.diff(upto, prepend=0)


def _turned(grid: np.ndarray) -> np.ndarray:
    """The transpose, copied in strips that stay in the processor's cache."""
    out = np.empty(grid.shape[::-1], grid.dtype)
    for at in range(0, len(grid), 64):
        out[:, at : at + 64] = grid[at : at + 64].T
    return out


def _parts(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """x // y of x below 2^53 and y above 0: a double's floor is exact there, and faster."""
    return (x / y).astype(np.int64)


def _lanes_of(n: int, longest: int) -> tuple[int, int]:
    lanes = max(1, min(longest, n // LEAST_RUN))
    return lanes, -(-n // lanes)


def _full(low: np.ndarray, wide: np.ndarray) -> np.ndarray:
    """Lanes whose interval is under 2^32 wide: their highest 32 bits are settled.  One that straddles two such words
    is cut to the lower one."""
    at = np.flatnonzero(wide <= _LOW32)
    room = (_LOW32 - (low.take(at) & _LOW32)) + _U(1)
    wide[at] = np.minimum(wide.take(at), room) << _32
    return at


def encode_ids(ids: np.ndarray, vocabulary: int, most_lanes: int = LANES) -> bytes:
    """Lane lengths (compressed) and 32-bit words of all lanes; ids must be below ``vocabulary``."""
    n = len(ids)
    if n == 0:
        return b""
    lanes, steps = _lanes_of(n, most_lanes)
    grid = np.zeros(lanes * steps, np.int32)
    grid[:n] = ids
    grid = _turned(grid.reshape(lanes, steps))
    model = Mixer(vocabulary, lanes, False)
    low, wide = np.zeros(lanes, _U), np.full(lanes, (1 << 64) - 1, _U)
    room = steps + 2
    out, first = np.zeros(lanes * room, np.uint32), np.arange(lanes) * room
    end = first.copy()
    for now in grid:
        guess_a, a, b = model.look()
        place, there = model.places(now)
        by = there.view(np.int8) << 1
        np.copyto(by, 1, where=now == guess_a)
        below, size = np.zeros(lanes, np.int64), a.copy()
        at = np.flatnonzero(by == 0)
        below[at], size[at] = model.slots0(now.take(at), a.take(at) + b.take(at))
        at = np.flatnonzero(by == 2)
        below[at], size[at] = model.slots1(model.part1.take(place.take(at)), *(x.take(at) for x in (model.all1, a, b)))
        part = wide >> _U(TOTAL_BITS)
        low += part * below.view(_U)
        wide = part * size.view(_U)
        at = _full(low, wide)
        full, place = low.take(at), end.take(at)
        out[place] = full >> _32
        low[at] = full << _32
        end[at] = place + 1
        model.learn(now, by)
    out[end] = low + _LOW32 >> _32  # the interval is wider than a word: with zeros after it, this one lies inside
    used = end + 1 - first
    table = zlib.compress(used.astype("<u4").tobytes(), 1)
    return struct.pack("<I", len(table)) + table + out.reshape(lanes, room)[np.arange(room) < used[:, None]].astype("<u4").tobytes()


def decode_ids(data: bytes, n: int, vocabulary: int, most_lanes: int = LANES) -> np.ndarray:
    """The ids that ``encode_ids`` was given."""
    if n == 0:
        return np.zeros(0, np.int64)
    lanes, steps = _lanes_of(n, most_lanes)
    size = struct.unpack_from("<I", data)[0] + 4
    length = np.frombuffer(zlib.decompress(data[4:size]), "<u4").astype(np.int64)
    stop = np.cumsum(length)
    end = stop - length
    if len(length) != lanes or len(data) != size + 4 * stop[-1] or length.min() < 1:
        raise ValueError("a block is cut short")
    words = np.append(np.frombuffer(data, "<u4", offset=size), 0).astype(np.uint32)
    model = Mixer(vocabulary, lanes, True)
    low, wide = np.zeros(lanes, _U), np.full(lanes, (1 << 64) - 1, _U)
    ahead = words[end].astype(_U) << _32 | np.where(length > 1, words[end + 1], 0)  # the code less low
    end += 2
    grid = np.empty((steps, lanes), np.int32)
    for step in range(steps):
        guess_a, a, b = model.look()
        part = wide >> _U(TOTAL_BITS)
        slot = np.minimum(ahead // part, _U(_TOTAL - 1)).view(np.int64)
        guessed = a + b
        by = (slot < guessed).view(np.int8) << 1
        np.copyto(by, 1, where=slot < a)
        now, below, size = guess_a.copy(), np.zeros(lanes, np.int64), a.copy()
        at = np.flatnonzero(by == 0)
        guessed = guessed.take(at)
        now[at] = ids = model.ids0(slot.take(at), guessed)
        below[at], size[at] = model.slots0(ids, guessed)
        at = np.flatnonzero(by == 2)
        all1, of_a, of_b = (x.take(at) for x in (model.all1, a, b))
        held = model.parts1(slot.take(at), at, all1, of_a, of_b)
        now[at] = held >> 2 * _PART_BITS
        below[at], size[at] = model.slots1(held, all1, of_a, of_b)
        past = part * below.view(_U)
        low += past
        ahead -= past
        wide = part * size.view(_U)
        at = _full(low, wide)
        low[at] = low.take(at) << _32
        place = end.take(at)
        ahead[at] = ahead.take(at) << _32 | np.where(place < stop.take(at), words.take(place, mode="clip"), 0)
        end[at] = place + 1
        model.learn(now, by)
        grid[step] = now
    return _turned(grid).reshape(-1)[:n].astype(np.int64)


@dataclass
class Block:
    """Documents of a range of ids: ``part`` is the range, ``start`` the token ids of the range before this block."""

    part: int
    start: int
    doc_ids: list[int | None]
    lengths: np.ndarray
    ids: np.ndarray


_HEAD = "<4sHIIQQIII"


def _checksum(fields: tuple, rest: bytes, ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes(), zlib.crc32(rest, zlib.crc32(struct.pack(_HEAD, *fields, 0))))


def write_block(block: Block, vocabulary: int) -> bytes:
    """magic, version, documents, part, start, token ids, vocabulary, bytes of the table and crc32 of all that, of
    the rest and of the token ids; then the table (document ids and lengths, compressed) and the coded ids."""
    ids = np.array([0 if d is None else d for d in block.doc_ids], "<i8")
    there = np.array([d is not None for d in block.doc_ids], bool)
    table = zlib.compress(ids.tobytes() + there.tobytes() + np.asarray(block.lengths).astype("<u8").tobytes(), 1)
    fields = (MAGIC, VERSION, len(block.doc_ids), block.part, block.start, len(block.ids), vocabulary, len(table))
    if not 0 < vocabulary < 1 << ZERO_BITS:
        raise ValueError(f"a vocabulary of {vocabulary} ids leaves some without a slot")
    coded = encode_ids(block.ids, vocabulary)
    return struct.pack(_HEAD, *fields, _checksum(fields, table + coded, block.ids)) + table + coded


def read_block(data: bytes) -> Block:
    """The block; raises ValueError if it is not one or its checksum fails."""
    head = struct.calcsize(_HEAD)
    if len(data) < head:
        raise ValueError("a block is cut short")
    *fields, crc = struct.unpack_from(_HEAD, data)
    magic, version, documents, part, start, n, vocabulary, size = fields
    if magic != MAGIC or version != VERSION:
        raise ValueError("not a block of token ids")
    table = data[head : head + size]
    try:
        held = zlib.decompress(table)
        doc_ids, there = np.frombuffer(held, "<i8", documents), np.frombuffer(held, bool, documents, 8 * documents)
        lengths = np.frombuffer(held, "<u8", documents, 9 * documents).astype(np.int64)
        if lengths.sum() != n or not 0 < vocabulary < 1 << ZERO_BITS:
            raise ValueError("a block's table is broken")
        ids = decode_ids(data[head + size :], n, vocabulary)
    except (zlib.error, struct.error, IndexError) as e:
        raise ValueError("a block is broken") from e
    if _checksum(fields, data[head:], ids) != crc:
        raise ValueError("a block's checksum fails")
    return Block(part, start, [int(d) if t else None for d, t in zip(doc_ids, there, strict=True)], lengths, ids)


def write_token_files(
    docs: DataFrame, tokenizer_path: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """The stored blocks: (part, block, n_ids, payload), in ascending order of ids.

    ``part`` is a range of ids and ``block`` its place there.  A payload is a whole block with its documents' ids and
    its own place; the other columns only spare readers a look into it.  Null text is empty; each document ends with
    ``end_id``.  Null ids come first; rows with one id are in order of their texts' hashes and texts, and repeated rows
    are written each.  A text of any length is encoded piece by piece.  An empty table gives no blocks.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    spec = spark.sparkContext.broadcast(open(tokenizer_path).read())
    tie = F.xxhash64("text")
    ordered = (
        docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(text_col, F.lit("")).alias("text"))
        .repartitionByRange(shuffle_width(spark), "doc_id", tie)
        .sortWithinPartitions("doc_id", tie, "text")
    )

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = PieceTokenizer.get(spec.value)
        vocabulary = max(tokenizer.tokenizer.get_vocab_size(), end_id + 1)
        part, number, start, held, doc_ids, coded = TaskContext.get().partitionId(), 0, 0, 0, [], []

        def close() -> pa.RecordBatch:
            payload = write_block(Block(part, start, doc_ids, np.array([len(x) for x in coded]), np.concatenate(coded)), vocabulary)
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.binary()]
            row = [part, number, held, payload]
            return pa.record_batch([pa.array([v], k) for v, k in zip(row, kinds, strict=True)], names=["part", "block", "n_ids", "payload"])

        for batch in slices(batches, 1 << 14, 8 << 20):
            found, bounds = tokenizer.encode(batch.column("text"), end_id)
            for doc, ids in zip(batch.column("doc_id").to_pylist(), np.split(found, bounds[1:-1]), strict=True):
                doc_ids.append(doc)
                coded.append(ids)
                held += len(ids)
                if held >= BLOCK_IDS:
                    yield close()
                    number, start, held, doc_ids, coded = number + 1, start + held, 0, [], []
        if doc_ids:
            yield close()

    return stored(ordered.mapInArrow(write, "part int, block int, n_ids long, payload binary"), "token-blocks")


def read_token_files(blocks: DataFrame, with_ids: bool = True) -> DataFrame:
    """A row per document read back from the blocks: doc_id, start, n_tokens, ids_crc32 and, if wanted, ids."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            block = read_block(batch.column("payload")[0].as_py())
            n = len(block.lengths)
            raw = block.ids.astype("<u4")
            ends = np.cumsum(block.lengths)
            starts = ends - block.lengths
            crc = [zlib.crc32(raw[a:b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
            columns = [
                pa.array([block.part] * n, pa.int32()), pa.array(block.doc_ids, pa.int64()),
                pa.array(starts + block.start), pa.array(block.lengths), pa.array(crc, pa.int64()),
            ]
            if with_ids:
                columns.append(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(raw.view("<i4"))))
            yield pa.record_batch(columns, names=["part", "doc_id", "place", "n_tokens", "ids_crc32", "ids"][: len(columns)])

    # A row per range: where it starts among all ids.
    parts = blocks.groupBy("part").agg(F.sum("n_ids").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = stored(parts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base")), "token-parts")
    schema = "part int, doc_id long, place long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids
    read_back = blocks.select("payload").mapInArrow(read, schema)
    return read_back.join(F.broadcast(bases), "part").select(
        "doc_id", (F.col("base") + F.col("place")).alias("start"), "n_tokens", "ids_crc32", *["ids"] * with_ids
    )
