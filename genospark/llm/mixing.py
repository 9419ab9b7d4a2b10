"""Mixing sources to target weights: Efraimidis-Spirakis sampling by exponential keys.

A source's target is some whole epochs and a fraction.  The whole epochs take every document; the fraction takes
documents in ascending order of ``-ln(u) / weight`` until their sizes reach the budget; weights are quality scores.
The order is found without sorting a source: keys are dealt to fine buckets of their logarithm, bucket sums are
prefix-summed, and only the bucket in which the budget ends is sorted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import ASCII_SPACE, shuffle_width, stored

#: Weight of the n-th source in order of its name, repeating.
WEIGHT_CYCLE = (5.0, 2.0, 1.0)
#: Weight of a document at least, so that a fraction may reach all of them.
LEAST_WEIGHT = 0.05


def word_count(text: Column) -> Column:
    """Number of ``[^\\x20\\x09-\\x0D]+`` in a text; null has none."""
    spaced = F.translate(F.coalesce(text, F.lit("")), ASCII_SPACE, " " * len(ASCII_SPACE))
    return F.size(F.filter(F.split(spaced, " "), lambda w: w != "")).cast("long")


def source_targets(sources: DataFrame, budget_share: float, max_epochs: float) -> DataFrame:
    """Adds ``target`` to (source, source_size): shares by weight, none above max_epochs times its size.

    The excess of capped sources is reshared by weight until none is above, which is the level L at which
    sum(min(cap, L * weight)) equals the budget.  It is found by one pass over the sources in order of cap / weight.
    The table has a row per source.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    cycle = F.array(*[F.lit(w) for w in WEIGHT_CYCLE])
    ranked = (
        sources.withColumn("rank", F.row_number().over(by_name) - 1)
        .withColumn("weight", F.element_at(cycle, (F.col("rank") % len(WEIGHT_CYCLE) + 1).cast("int")))
        .withColumn("cap", max_epochs * F.col("source_size"))
    )
    order = Window.orderBy(F.col("cap") / F.col("weight"), "rank")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    onward = order.rowsBetween(0, Window.unboundedFollowing)
    all_rows = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing).orderBy(F.lit(1))
    levels = (
        ranked.withColumn("budget", budget_share * F.sum("source_size").over(all_rows))
        .withColumn("left", F.col("budget") - F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
        .withColumn("level", F.try_divide(F.col("left"), F.sum("weight").over(onward)))
        .withColumn("fits", F.col("level") * F.col("weight") <= F.col("cap"))
    )
    # Once the level of one row fits its cap, it is the level of every later row.
    first = F.first(F.when(F.col("fits"), F.col("level")), ignorenulls=True)
    return levels.withColumn("final", first.over(order.rowsBetween(Window.unboundedPreceding, 0))).select(
        "source",
        "source_size",
        F.least(F.col("cap"), F.coalesce(F.col("final") * F.col("weight"), F.col("cap"))).alias("target"),
    )


def mix(
    docs: DataFrame,
    budget_share: float = 1.5,
    max_epochs: float = 2.0,
    seed: int = 17,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    keep: tuple[str, ...] = (),
    weight_col: str | None = None,
    size_col: str | None = None,
) -> DataFrame:
    """One row per input row: doc_id, source, size, source_size, target, epochs, fractional, copies, taken.

    ``copies`` is how often the mix takes the document, ``taken`` its words in all.  Null text has size 0; a
    document without words is taken once in each whole epoch and adds nothing.  A null source is a source of its
    own and comes last.  Ties of keys fall to the smaller id, then to the text's hash; equal rows have equal keys
    and any of them may be the one that the fraction takes.  Reruns agree, as keys are hashes of the id, the text
    and the seed.  Sources of no words have target 0 and take nothing.  An empty table gives an empty result.
    ``weight_col`` has the documents' weights, LEAST_WEIGHT at least; without it, or where it is null, they are 1.
    ``size_col`` has the sizes, if they are counted already.  ``keep`` names further columns to pass through.
    """
    spark = docs.sparkSession
    text = F.col(text_col)
    # 53 random bits in (0, 1]
    u = (F.shiftrightunsigned(F.xxhash64(F.col(id_col), text, F.lit(seed)), 11) + 1) / F.lit(float(1 << 53))
    weight = F.greatest(F.coalesce(F.col(weight_col), F.lit(1.0)), F.lit(LEAST_WEIGHT)) if weight_col else F.lit(1.0)
    rows = stored(
        docs.select(
            F.col(id_col).alias("doc_id"),
            F.col(source_col).alias("source"),
            (F.col(size_col).cast("long") if size_col else word_count(text)).alias("size"),
            (-F.log(u) / weight).alias("key"),
            F.xxhash64(text).alias("tie"),
            *keep,
        ),
        "mix-rows",
    )
    # Nearly all keys of one weight lie within four octaves, so a fine scale of octaves spreads them, whatever the
    # weights are.
    n = rows.count()
    steps = max(64, min(1 << 16, n >> 12))
    octave = F.log2(F.greatest(F.col("key"), F.lit(1e-15)))
    bucket = F.floor(octave * steps).alias("bucket")
    sums = stored(
        rows.groupBy("source", bucket).agg(F.sum("size").alias("words"), F.count(F.lit(1)).alias("n")), "mix-sums"
    )
    targets = source_targets(
        sums.groupBy("source").agg(F.sum("words").alias("source_size")), budget_share, max_epochs
    )
    targets = stored(
        targets.withColumn("epochs", F.coalesce(F.floor(F.try_divide("target", "source_size")), F.lit(0))).withColumn(
            "fraction", F.col("target") - F.col("epochs") * F.col("source_size")
        ),
        "mix-targets",
    )
    # The bucket of each source in which the fraction's budget ends, and the words before it.
    run = Window.partitionBy("source").orderBy("bucket")
    ends = (
        sums.withColumn("upto", F.sum("words").over(run))
        .join(targets.select(F.col("source").alias("_s"), "fraction"), F.col("source").eqNullSafe(F.col("_s")))
        .where("fraction > 0 and upto >= fraction")
        .groupBy("source")
        .agg(F.min_by(F.struct("bucket", (F.col("upto") - F.col("words")).alias("before")), "bucket").alias("e"))
        .select(F.col("source").alias("_s"), F.col("e.bucket").alias("end_bucket"), F.col("e.before").alias("before"))
    )
    facts = targets.join(ends, F.col("source").eqNullSafe(F.col("_s")), "left").drop("_s")
    facts = facts.select(F.col("source").alias("_source"), *[c for c in facts.columns if c != "source"])
    # A row per source, not per document; stored, so that Spark knows its size when it picks the join.
    facts = stored(facts, "mix-facts")
    told = rows.withColumn("bucket", bucket).join(facts, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    inside = (F.col("fraction") > 0) & (F.col("end_bucket").isNull() | (F.col("bucket") < F.col("end_bucket")))
    edge = F.coalesce(F.col("bucket") == F.col("end_bucket"), F.lit(False))
    width = shuffle_width(spark)
    within = Window.partitionBy("source", "bucket").orderBy("key", "doc_id", "tie")
    at_edge = (
        told.where(edge)
        .repartition(width, "source", "bucket")
        .withColumn("upto", F.sum("size").over(within.rowsBetween(Window.unboundedPreceding, 0)) + F.col("before"))
        # The document on the edge is taken if that comes nearer to the target.
        .withColumn("fractional", F.col("upto") - F.col("size") / 2 <= F.col("fraction"))
        .drop("upto")
    )
    out = told.where(~edge).withColumn("fractional", inside).unionByName(at_edge)
    out = out.withColumn("copies", F.col("epochs") + F.col("fractional").cast("long"))
    return out.select(
        "doc_id", "source", "size", "source_size", "target", "epochs", "fractional", "copies",
        (F.col("copies") * F.col("size")).alias("taken"), *keep,
    )
