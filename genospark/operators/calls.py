"""Joins, reshaping and per-marker statistics of ``calls(individual, marker, dosage)``.

A missing call is a null dosage or an absent row; denominators count distinct individuals, never rows.  Undefined
statistics are null, not NaN.  Calls may also have ``row_idx`` and ``marker_idx``, the places of individuals and markers in
their file: indices follow these, and the names where they are not there.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ranks import numbered


def individuals(calls: DataFrame) -> DataFrame:
    return calls.select("individual").distinct()


def cells(calls: DataFrame) -> DataFrame:
    """The calls without places."""
    return calls.select("individual", "marker", "dosage")


def n_individuals(calls: DataFrame) -> Column:
    """The number of individuals, as a scalar subquery: no join and no action."""
    return calls.agg(F.countDistinct("individual").alias("n")).scalar()


def frequency() -> Column:
    return F.try_divide(F.sum("dosage"), 2.0 * F.count("dosage"))


def allele_frequencies(calls: DataFrame) -> DataFrame:
    return calls.groupBy("marker").agg(frequency().alias("frequency"))


def minor(f: Column) -> Column:
    return F.when(f.isNotNull(), F.least(f, 1 - f))


def minor_allele_frequencies(calls: DataFrame) -> DataFrame:
    return allele_frequencies(calls).select("marker", minor(F.col("frequency")).alias("maf"))


def call_rates(calls: DataFrame) -> DataFrame:
    return calls.groupBy("marker").agg(F.count("dosage").alias("n")).select("marker", (F.col("n") / n_individuals(calls)).alias("call_rate"))


def heterozygosity() -> Column:
    """The share of calls that are exactly 1."""
    return F.try_divide(F.count_if(F.col("dosage") == 1).cast("double"), F.count("dosage"))


def heterozygosities(calls: DataFrame) -> DataFrame:
    return calls.groupBy("marker").agg(heterozygosity().alias("heterozygosity"))


def column_statistics(calls: DataFrame) -> DataFrame:
    """(marker, mean, std) of observed calls; nothing observed means 0, and no spread (or one value) a std of 1."""
    std = F.stddev_samp("dosage")
    return calls.groupBy("marker").agg(
        F.coalesce(F.avg("dosage"), F.lit(0.0)).alias("mean"),
        F.when((F.count("dosage") > 1) & (std > 0), std).otherwise(1.0).alias("std"),
    )


def align(calls: DataFrame, wanted: DataFrame) -> DataFrame:
    """Calls of the individuals in ``wanted``, a set."""
    return calls.join(wanted.select("individual"), "individual", "left_semi")


#: Markers that meet an individual in one row before they are spread out; markers up to which these rows are broadcast
#: (some 20 MB), and parts that each block's individuals are dealt to beyond.
GRID_BLOCK, GRID_BROADCAST, GRID_PARTS = 1024, 1 << 18, 16


def _grid(calls: DataFrame, per_marker: DataFrame) -> DataFrame:
    """A row per individual and marker with the marker's columns.  The result itself has that many rows.

    Markers are dealt to blocks by hash; individuals meet each block once, and the calls join by the cell's key.  Beyond
    GRID_BROADCAST markers each block is copied to GRID_PARTS parts of the individuals, so that no block is one task's.
    """
    columns = per_marker.columns
    n = per_marker.count()
    blocks = max(1, -(-n // GRID_BLOCK))
    block = F.pmod(F.xxhash64("marker"), F.lit(blocks)).cast("int").alias("_block")
    markers = per_marker.groupBy(block).agg(F.collect_list(F.struct(*columns)).alias("m"))
    people = individuals(calls).select("individual", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("_block"))
    if n <= GRID_BROADCAST:
        met = people.join(F.broadcast(markers), "_block")
    else:
        people = people.withColumn("_part", F.pmod(F.xxhash64("individual"), F.lit(GRID_PARTS)).cast("int"))
        copied = markers.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(GRID_PARTS - 1))))
        met = people.join(copied, ["_block", "_part"])
    grid = met.select("individual", F.explode("m").alias("m")).select("individual", *[F.col(f"m.{c}") for c in columns])
    return grid.join(cells(calls), ["individual", "marker"], "left")


def imputed_calls(calls: DataFrame, impute: bool = True) -> DataFrame:
    """The full grid with missing calls replaced by the marker's mean (0 for a marker without calls)."""
    if not impute:
        return _grid(calls, calls.select("marker").distinct())
    grid = _grid(calls, column_statistics(calls).select("marker", "mean"))
    return grid.select("individual", "marker", F.coalesce("dosage", "mean").alias("dosage"))


def standardized_calls(calls: DataFrame, impute: bool = True) -> DataFrame:
    """The full grid of (dosage - mean) / std; a missing call is the mean, or the value 0 without ``impute``."""
    grid = _grid(calls, column_statistics(calls))
    value = F.coalesce(F.col("dosage"), F.col("mean") if impute else F.lit(0.0))
    return grid.select("individual", "marker", ((value - F.col("mean")) / F.col("std")).alias("z"))


def standardized_entries(calls: DataFrame) -> DataFrame:
    """(individual, marker, z) of observed calls only: what is absent is 0."""
    stats = column_statistics(calls)
    observed = cells(calls).where("dosage is not null")
    return observed.join(stats, "marker").select("individual", "marker", ((F.col("dosage") - F.col("mean")) / F.col("std")).alias("z"))


def reorder_markers(calls: DataFrame, markers: DataFrame) -> DataFrame:
    """The grid of ``markers(marker_idx, marker)``: extra markers go, unknown ones are all missing."""
    return _grid(calls.select("individual", "marker", "dosage"), markers.select("marker_idx", "marker")).select("individual", "marker_idx", "marker", "dosage")


def _index(calls: DataFrame, name: str, index: str) -> DataFrame:
    if index not in calls.columns:
        return numbered(calls.select(name).distinct(), index, name)
    first = calls.groupBy(name).agg(F.min(index).alias("_place"))
    return numbered(first, index, "_place", name).select(name, index)


def marker_index(calls: DataFrame) -> DataFrame:
    """(marker, marker_idx): markers in order of their places in the file, or else of their names, from 0."""
    return _index(calls, "marker", "marker_idx")


def individual_index(calls: DataFrame) -> DataFrame:
    """(individual, row_idx): individuals in order of their places in the file, or else of their names, from 0."""
    return _index(calls, "individual", "row_idx")
