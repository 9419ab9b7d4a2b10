"""Exact dedup: two passes of Bloom filtering, after which only possibly repeated rows shuffle.  Pass 1 itself shuffles
narrow (word, bit, count) records for nearly every row.

A filter is a table of 64-bit words.  Each pass hashes a row to one word and ``HASHES`` bits of it, counts how many rows
hit each bit (partial sums on the map side) and keeps the bits that more than one row hit.  A row of which any bit is
not kept is surely unique and passes straight through.  A filter of at most ``max_slots`` bits is broadcast.  Where the
rows are too many for one, their digests are dealt to ranges with a filter each, all in one job: narrow rows then meet
their range's words in a shuffled join, except for the few words that very many rows hit, which are broadcast.  Digests
decide in the end: filters only spare work.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored

#: Bits of a filter at most (a broadcast of at most 2^22 words), bits for each row, and bits that a row hits.
MAX_SLOTS = 1 << 28
SLOTS_PER_ROW, HASHES = 16, 2
#: A group above this share of the rows is hot, and in large tables one of HOT_ROWS rows already, as long as no more than
#: 2^HOT_BITS groups can be: these are broadcast.
HOT_SHARE, HOT_ROWS, HOT_BITS = 0.001, 10_000, 17


def _hot_from(n: int) -> int:
    return max(2, min(int(n * HOT_SHARE), max(HOT_ROWS, n >> HOT_BITS)))


class _Filter:
    """The word and the bits of a digest in one pass's filters of ``slots`` bits, one for each range."""

    def __init__(self, seed: int, slots: int, ranges: int = 1):
        word = F.pmod(F.xxhash64("text_sha256", F.lit(2 * seed)), F.lit(slots // 64))
        if ranges > 1:
            word = word + F.shiftright(F.conv(F.substring("text_sha256", 1, 8), 16, 10).cast("long") * ranges, 32) * (slots // 64)
        self.word, self.ranges = word, ranges
        h = F.xxhash64("text_sha256", F.lit(2 * seed + 1))
        self.bits = [F.shiftrightunsigned(h, 6 * i).bitwiseAND(F.lit(63)).cast("int") for i in range(HASHES)]

    def mask(self) -> Column:
        out = F.lit(0).cast("long")
        for bit in self.bits:
            out = out.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), bit))
        return out

    def build(self, rows: DataFrame) -> DataFrame:
        """(word, kept, hits): the bits that more than one row hit, and the most hits of one; ``word`` is unique."""
        hits = rows.select(self.word.alias("word"), F.explode(F.array_distinct(F.array(*self.bits))).alias("bit"))
        twice = hits.groupBy("word", "bit").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        return twice.groupBy("word").agg(F.bit_or(F.expr("shiftleft(1L, bit)")).alias("kept"), F.max("n").alias("hits"))

    def may_repeat(self, rows: DataFrame, words: DataFrame, flag: str, n: int) -> DataFrame:
        """``flag``: whether all of the row's bits are kept.  The words of one filter are bounded, so they are broadcast."""
        rows = rows.withColumn("word", self.word).withColumn("_mask", self.mask())
        hit = F.coalesce(F.col("kept").bitwiseAND(F.col("_mask")) == F.col("_mask"), F.lit(False))
        words = words.select("word", "kept", "hits")
        if self.ranges == 1:
            met = rows.join(F.broadcast(words), "word", "left")
        else:
            # Each row hits one word, so hot words are as few as hot groups; their rows take words that no filter has into
            # the shuffle, spread by the row's id.
            hot = F.col("hits") >= _hot_from(n)
            told = F.broadcast(words.where(hot).select("word", F.col("kept").alias("hot_kept")))
            met = rows.join(told, "word", "left")
            met = met.withColumn("word", F.when(F.col("hot_kept").isNull(), F.col("word")).otherwise(-1 - F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40))))
            met = met.join(words.where(~hot), "word", "left").withColumn("kept", F.coalesce("hot_kept", "kept")).drop("hot_kept")
        return met.withColumn(flag, hit).drop("word", "kept", "_mask", "hits")


def possibly_repeated(digests: DataFrame, n: int, max_slots: int = MAX_SLOTS) -> DataFrame:
    """``digests`` (doc_id, text_sha256; n rows) with ``repeated``, false only for rows whose digest no other row has."""
    ranges = max(1, -(-n * SLOTS_PER_ROW // max_slots))
    slots = 1 << 12
    while slots < SLOTS_PER_ROW * n and slots < max_slots:
        slots <<= 1
    first, second = _Filter(0, slots, ranges), _Filter(1, slots, ranges)
    # Pass 1 over all rows, pass 2 over those that pass 1 could not clear.
    words1 = stored(first.build(digests), "exact-words1")
    seen = first.may_repeat(digests, words1, "seen", n)
    if ranges > 1:
        seen = stored(seen, "exact-seen")
    suspects = seen.where("seen").drop("seen")
    words2 = stored(second.build(suspects), "exact-words2")
    if ranges > 1:
        cleared = seen.where("not seen").withColumnRenamed("seen", "repeated")
        return cleared.unionByName(second.may_repeat(suspects, words2, "repeated", n))
    marked = second.may_repeat(seen, words2, "seen2", n)
    return marked.withColumn("repeated", F.expr("seen and seen2")).drop("seen", "seen2")


def _grouped(digests: DataFrame, n: int, max_slots: int) -> DataFrame:
    """Rows (doc_id, keep_id, group_size, text_sha256) of ``n`` digests."""
    marked = possibly_repeated(digests, n, max_slots)
    unique = marked.where("not repeated").select(
        "doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), "text_sha256"
    )
    repeated = marked.where("repeated").select("doc_id", "text_sha256")
    groups = stored(
        repeated.groupBy("text_sha256").agg(
            F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")
        ),
        "exact-groups",
    )
    # Hot groups are few by definition and meet their rows by broadcast; no key of the shuffled join is hot.
    hot_from = _hot_from(n)
    hot = groups.where(F.col("group_size") >= hot_from).withColumn("hot", F.lit(True))
    split = repeated.join(F.broadcast(hot), "text_sha256", "left")
    of_hot = split.where("hot").drop("hot")
    of_rest = (
        split.where("hot is null")
        .select("doc_id", "text_sha256")
        .join(groups.where(F.col("group_size") < hot_from), "text_sha256")
    )
    names = ["doc_id", "keep_id", "group_size", "text_sha256"]
    return unique.select(names).unionByName(of_hot.select(names)).unionByName(of_rest.select(names))


def exact_dedup(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_slots: int = MAX_SLOTS
) -> DataFrame:
    """One row per input row: id, ``keep_id``, ``group_size``, ``kept``, ``text_sha256``.

    Of rows with identical texts the largest id stays.  Null text counts as empty, so all null and empty texts
    form one group.  Rows that repeat an id with the same text count in the group and are kept or dropped alike.
    Ids may be of any type that has an order; a null id is smaller than any other.  Other columns of the input are
    not read.  An empty table gives an empty result.  ``max_slots`` bounds a filter; more rows than it holds take a
    filter a range.  Texts are read whole, once.
    """
    # One scan of the texts; everything after it works on digests.
    digests = stored(
        docs.select(
            F.col(id_col).alias("doc_id"),
            F.sha2(F.coalesce(F.col(text_col), F.lit("")).cast("binary"), 256).alias("text_sha256"),
        ),
        "exact-digests",
    )
    out = _grouped(digests, digests.count(), max_slots)
    return out.select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256"
    )
