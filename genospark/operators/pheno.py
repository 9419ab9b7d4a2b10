"""Phenotypes: summaries, z-scores, alignment, folds, and measures of fit."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .calls import individuals
from .ranks import numbered


def last_values(pheno: DataFrame) -> DataFrame:
    """One value per individual: that of the largest ``row_idx``."""
    return pheno.groupBy("individual").agg(F.max_by("value", "row_idx").alias("value"))


def subset(pheno: DataFrame, wanted: DataFrame) -> DataFrame:
    """The wanted ids that have a value, as often as they are wanted, each with its own last value."""
    return wanted.join(last_values(pheno), "individual")


def align(pheno: DataFrame, calls: DataFrame) -> DataFrame:
    """The last values of the individuals that have calls."""
    return subset(pheno, individuals(calls))


def summary(pheno: DataFrame) -> DataFrame:
    """One row: count, mean, std, min, q25, q50, q75, max.

    Quartiles are values by position: n // 4 and 3n // 4 from 0; the median averages the middle two.  One value has
    std 0.  No value is an error.
    """
    placed = numbered(pheno.where("value is not null").select("value"), "at", "value")
    placed = placed.withColumn("n", placed.agg(F.count(F.lit(1)).alias("n")).scalar())
    at = lambda e: F.max(F.when(F.col("at") == F.expr(e), F.col("value")))
    out = placed.agg(
        F.count("value").alias("count"), F.avg("value").alias("mean"), F.coalesce(F.stddev_samp("value"), F.lit(0.0)).alias("std"),
        F.min("value").alias("min"), at("n div 4").alias("q25"), F.percentile("value", 0.5).alias("q50"), at("(3 * n) div 4").alias("q75"),
        F.max("value").alias("max"),
    )
    none = F.raise_error(F.lit("no phenotype values")).cast("double")
    return out.withColumn("mean", F.when(F.col("count") == 0, none).otherwise(F.col("mean")))


def normalize(pheno: DataFrame) -> DataFrame:
    """z-scores with the sample standard deviation; no value or no variance is an error."""
    facts = pheno.agg(F.struct(F.avg("value").alias("mean"), F.stddev_samp("value").alias("std")).alias("s")).scalar()
    flat = F.raise_error(F.lit("the phenotype has no variance")).cast("double")
    told = pheno.withColumn("_s", facts)
    std = F.when(F.col("_s.std") > 0, F.col("_s.std")).otherwise(flat)
    return told.select("individual", ((F.col("value") - F.col("_s.mean")) / std).alias("z"))


def moments(df: DataFrame, column: str, ddof: int = 1) -> DataFrame:
    """One row: mean, variance and standard deviation; fewer values than ``ddof`` + 1 are an error."""
    few = F.raise_error(F.lit("too few values")).cast("double")
    var = F.when(F.count(column) <= ddof, few).otherwise(F.var_samp(column) if ddof == 1 else F.var_pop(column))
    return df.agg(F.avg(column).alias("mean"), var.alias("variance"), F.sqrt(var).alias("std"))


def pearson(x: str, y: str):
    """Correlation of two columns as an aggregate; under two pairs or no variance is null."""
    both = F.col(x).isNotNull() & F.col(y).isNotNull()
    a, b = F.when(both, F.col(x)), F.when(both, F.col(y))
    # Not corr(), which divides by 0 where a column is constant.
    spread = F.sqrt(F.var_pop(a)) * F.sqrt(F.var_pop(b))
    return F.when((F.count(a) > 1) & (spread > 0), F.try_divide(F.covar_pop(a, b), spread))


def rmse(true: str, predicted: str):
    return F.sqrt(F.avg((F.col(true) - F.col(predicted)) * (F.col(true) - F.col(predicted))))


def assign_folds(samples: DataFrame, n_splits: int, seed: int = 0) -> DataFrame:
    """``fold`` from 0: disjoint, covering, and of sizes that differ by one at most, the first ones larger.

    The order is the md5 of seed and id.
    """
    placed = numbered(samples, "_at", F.md5(F.concat(F.lit(f"{seed}:"), F.col("individual"))), "individual")
    n = placed.agg(F.count(F.lit(1)).alias("n")).scalar()
    placed = placed.withColumn("_size", F.floor(n / n_splits)).withColumn("_more", n % n_splits)
    wide = "_more * (_size + 1)"  # individuals in the folds of one more
    fold = F.expr(f"case when _at < {wide} then _at div (_size + 1) else _more + (_at - {wide}) div _size end")
    return placed.withColumn("fold", fold.cast("long")).drop("_at", "_size", "_more")


def marker_correlations(calls: DataFrame, pheno: DataFrame) -> DataFrame:
    """Pearson correlation of each marker's calls with the phenotype."""
    return calls.join(pheno, "individual").groupBy("marker").agg(pearson("dosage", "value").alias("r"))
