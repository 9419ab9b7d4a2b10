"""Line dedup: lines are told apart by hash, in ranges of (hash, document) sorted by position.

The texts don't shuffle with their lines: a line is two 64-bit hashes, its document's key and its position.  The rows
of a range stream in order, so the first place of a hash in a document is where the row before is another one's.  The
result is a compressed bitmap of kept lines per document, from which ``apply_bitmaps`` makes the kept texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import ASCII_SPACE, discard, lower_ascii, shuffle_width, stored

#: Repeated lines that are broadcast at most (two longs each): the most frequent ones.  Others are each too rare to
#: make a key of the shuffled join hot.
BROADCAST_KEYS = 1 << 18
#: Bits of the broadcast table that lets texts which lose nothing by (2^22 words at most; it spares less and less beyond
#: some 10^8 texts that lose lines).
MAX_SLOTS = 1 << 28


def lines_of(text: Column) -> Column:
    """The lines of a text; null is one empty line, as is an empty text."""
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_key(line: Column) -> Column:
    return lower_ascii(F.btrim(line, F.lit(ASCII_SPACE)))


def line_bitmaps(
    docs: DataFrame,
    min_docs: int = 10,
    min_chars: int = 1,
    keep_first: bool = False,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Rows (doc_id, text_hash, keep_bits) for the documents that lose lines.

    A key of at least ``min_chars`` code points found in at least ``min_docs`` documents loses its lines in all
    documents, or in all places but the first by (id, position) with ``keep_first``.  ``keep_bits`` is a bitmap of the
    lines that stay in sorted pieces (word, bits): bit i of piece w is line 64 w + i.  Pieces whose lines all stay are
    left out, so a document's bitmap is as long as what it loses; bits past its last line are set.  A document is told
    by its id and its text's hash, so rows that repeat both count as one document, and rows that share only the id
    count apart.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col), F.lit(""))
    lines = docs.select(
        F.col(id_col).alias("doc_id"),
        F.xxhash64(text).alias("text_hash"),
        F.posexplode(lines_of(F.col(text_col))).alias("pos", "line"),
    )
    key = line_key(F.col("line"))
    # Stored, so that finding the ranges' bounds reads a narrow table and no text.
    lines = stored(
        lines.where(F.length(key) >= min_chars).select(
            F.xxhash64(key).alias("h1"), F.xxhash64(key, F.lit(1)).alias("h2"), "doc_id", "text_hash", "pos"
        ),
        "line-hashes",
    )
    # Ranges of (key, document): the lines of a very common key spread over many ranges, while the lines of one
    # document with one key stay together, so the window below needs no further exchange or sort.
    group = ["h1", "h2", "doc_id", "text_hash"]
    ranged = lines.repartitionByRange(shuffle_width(spark), *group).sortWithinPartitions(*group, "pos")
    before = F.lag("pos").over(Window.partitionBy(*group).orderBy("pos"))
    places = stored(
        ranged.withColumn("before", before)
        .where(F.col("before").isNull() | (F.col("before") != F.col("pos")))  # repeated rows have one place
        .select(*group, "pos", F.col("before").isNull().cast("long").alias("opens")),
        "line-places",
    )
    discard(lines)
    # A range gives at most one row for a key here, whatever its lines.
    repeated = stored(
        places.groupBy("h1", "h2")
        .agg(F.sum("opens").alias("n"), F.min(F.struct("doc_id", "text_hash", "pos")).alias("first"))
        .where(F.col("n") >= min_docs),
        "line-repeated",
    )
    told = repeated.agg(F.count(F.lit(1)).alias("keys"), F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()
    # No more than n / t keys have t documents or more.
    hot_from = 0 if told["keys"] <= BROADCAST_KEYS else told["n"] // max(BROADCAST_KEYS, 1) + 1
    hot = repeated.where(F.col("n") >= hot_from).drop("n")
    found = places.join(F.broadcast(hot), ["h1", "h2"])
    if hot_from:
        rest = repeated.where(F.col("n") < hot_from).drop("n")
        found = found.unionByName(places.join(F.broadcast(hot), ["h1", "h2"], "left_anti").join(rest, ["h1", "h2"]))
    if keep_first:
        found = found.where(~F.struct("doc_id", "text_hash", "pos").eqNullSafe(F.col("first")))
    # Whole longs are built before the last exchange: (document, long) then document.
    bits = (
        found.groupBy("doc_id", "text_hash", F.expr("cast(pos div 64 as int)").alias("word"))
        .agg(F.bitwise_not(F.bit_or(F.expr("shiftleft(1L, pos % 64)"))).alias("bits"))
        .groupBy("doc_id", "text_hash")
        .agg(F.sort_array(F.collect_list(F.struct("word", "bits"))).alias("keep_bits"))
    )
    return bits


def apply_bitmaps(docs: DataFrame, bitmaps: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with ``n_lines``, ``n_dropped`` and ``kept_text``: the lines that stay, joined by newlines.

    Null and empty texts have one empty line, which stays.  Repeated rows get the same bitmap.  The id may be null.
    Columns that are called as the new ones are replaced.  Whole texts are read; one row holds all its lines.  An empty
    table gives an empty result, and without bitmaps every line stays.

    A bit table of the bitmaps' text hashes is broadcast: texts that it does not hold pass straight through, and only
    the others meet their bitmaps in a shuffle.
    """
    made = ["n_lines", "n_dropped", "kept_text", "_bits", "_id", "_hash", "_text_hash", "_lines", "_kept", "_word", "_set"]
    docs = docs.drop(*made)
    names = [*docs.columns, "n_lines", "n_dropped", "kept_text"]
    bitmaps = stored(bitmaps, "line-bitmaps")
    word, bit = (f"pmod({{}}, {MAX_SLOTS}) div 64", f"cast(pmod({{}}, {MAX_SLOTS}) % 64 as int)")
    losing = bitmaps.groupBy(F.expr(word.format("text_hash")).alias("_word")).agg(
        F.bit_or(F.expr(f"shiftleft(1L, {bit.format('text_hash')})")).alias("_set")
    )
    losing = F.broadcast(stored(losing, "line-losing"))
    text = F.coalesce(F.col(text_col), F.lit(""))
    told = docs.withColumn("_text_hash", F.xxhash64(text)).withColumn("_word", F.expr(word.format("_text_hash")))
    hit = F.expr(f"(shiftright(_set, {bit.format('_text_hash')}) & 1L) = 1L")
    lines = lines_of(F.col(text_col))
    whole = told.join(losing, "_word", "left").where(~F.coalesce(hit, F.lit(False)))
    whole = whole.withColumn("n_lines", F.size(lines).cast("long")).withColumn("n_dropped", F.lit(0).cast("long"))
    whole = whole.withColumn("kept_text", text).select(names)
    # All pieces in a row up to the last that is held; before the join, so that it is done once a document.
    gap = "x.word - coalesce(get(keep_bits, i - 1).word, -1) - 1"
    dense = F.expr(f"flatten(transform(keep_bits, (x, i) -> concat(array_repeat(-1L, {gap}), array(x.bits))))")
    marks = bitmaps.select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"), dense.alias("_bits"))
    # A sort-merge join at every size: the bitmaps grow with the texts.
    joined = told.join(losing, "_word").where(hit).join(
        marks.hint("merge"), (F.col("_text_hash") == F.col("_hash")) & F.col(id_col).eqNullSafe(F.col("_id")), "left"
    )
    stays = F.expr(
        "filter(_lines, (x, i) -> coalesce((shiftright(get(_bits, cast(i div 64 as int)), i % 64) & 1L) = 1L, true))"
    )
    joined = joined.withColumn("_lines", lines).withColumn("n_lines", F.size("_lines").cast("long"))
    joined = joined.withColumn("_kept", F.when(F.col("_bits").isNull(), F.col("_lines")).otherwise(stays))
    joined = joined.withColumn("n_dropped", F.col("n_lines") - F.size("_kept"))
    return whole.unionByName(joined.withColumn("kept_text", F.array_join("_kept", "\n")).select(names))


def line_dedup(docs: DataFrame, **options) -> DataFrame:
    """``apply_bitmaps`` of ``line_bitmaps``; ``options`` are those of the latter."""
    columns = {k: v for k, v in options.items() if k in ("id_col", "text_col")}
    return apply_bitmaps(docs, line_bitmaps(docs, **options), **columns)
