"""Quality control of markers: metrics in one grouped pass, thresholds, and the filtered calls."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.tails import chi_square_sf_1df
from .calls import frequency, heterozygosity, minor, n_individuals


def _hwe_counts() -> list[Column]:
    """Calls that round (half to even) to 0, 1 and 2; others do not count."""
    rounded = F.bround("dosage", 0)
    return [F.count_if(rounded == k).alias(f"n{k}") for k in (0, 1, 2)]


def _hwe_chi2() -> Column:
    """Chi-square of the counts against their expectation; terms whose expectation is 0 are skipped."""
    n = (F.col("n0") + F.col("n1") + F.col("n2")).cast("double")
    p = F.try_divide(2.0 * F.col("n2") + F.col("n1"), 2.0 * n)
    expected = ((1 - p) * (1 - p) * n, 2.0 * p * (1 - p) * n, p * p * n)
    terms = [F.when(e == 0, 0.0).otherwise(F.try_divide((F.col(f"n{k}") - e) * (F.col(f"n{k}") - e), e)) for k, e in enumerate(expected)]
    return F.when(n > 0, terms[0] + terms[1] + terms[2])


def compute_metrics(calls: DataFrame) -> DataFrame:
    """(marker, call_rate, maf, heterozygosity, hwe_pvalue)."""
    grouped = calls.groupBy("marker").agg(
        frequency().alias("f"), F.count("dosage").alias("called"), heterozygosity().alias("heterozygosity"), *_hwe_counts()
    )
    return grouped.select(
        "marker", (F.col("called") / n_individuals(calls)).alias("call_rate"), minor(F.col("f")).alias("maf"),
        "heterozygosity", chi_square_sf_1df(_hwe_chi2()).alias("hwe_pvalue"),
    )


def filter_markers(calls: DataFrame, maf: float = 0.01, call_rate: float = 0.95, hwe_p: float = 1e-6) -> DataFrame:
    """Metrics with fail_call_rate, fail_maf, fail_hwe and keep.  Thresholds are strict; an undefined metric passes."""
    below = lambda c, t: F.coalesce(F.col(c) < t, F.lit(False))
    flagged = compute_metrics(calls).select(
        "*", below("call_rate", call_rate).alias("fail_call_rate"), below("maf", maf).alias("fail_maf"), below("hwe_pvalue", hwe_p).alias("fail_hwe")
    )
    return flagged.withColumn("keep", ~(F.col("fail_call_rate") | F.col("fail_maf") | F.col("fail_hwe")))


def failing_markers(flags: DataFrame) -> DataFrame:
    """(marker, test) for each test that a marker fails."""
    tests = [F.when(F.col(f"fail_{t}"), F.lit(t)) for t in ("call_rate", "maf", "hwe")]
    return flags.select("marker", F.explode(F.array_compact(F.array(*tests))).alias("test"))


def apply_filter(calls: DataFrame, flags: DataFrame) -> DataFrame:
    """The calls of kept markers; individuals are never filtered."""
    kept = calls.join(flags.where("keep").select("marker"), "marker", "left_semi")
    return kept.select(*calls.columns)
