"""Principal components of standardised genotypes."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..storage import stored
from .calls import cells, column_statistics, individual_index, marker_index
from .linalg import sparse_rows, top_eigenpairs


@dataclass
class PCAModel:
    """``markers(marker, marker_idx, mean, std, loadings)`` and ``components(component, eigenvalue,
    residual)``, the last being what ``linalg.top_eigenpairs`` left."""

    markers: DataFrame
    components: DataFrame
    k: int


def fit_pca(calls: DataFrame, n_components: int = 10, scale: bool = True) -> PCAModel:
    """The eigenvectors of the covariance of the standardised matrix (missing calls are the mean).

    The Gram matrix of the smaller side is summed on the executors and decomposed on the driver, or, where that side is
    too large, worked on by passes over the rows (``linalg.top_eigenpairs``).
    Each component's loadings sum to 0 or more.  Without ``scale`` the model stores mean 0 and std 1, so scores are
    not centred and a missing call scores 0, while the covariance is centred all the same.
    """
    spark = calls.sparkSession
    stats = column_statistics(calls)
    if not scale:
        stats = stats.withColumn("std", F.lit(1.0))
    markers = stored(stats.join(marker_index(calls), "marker"), "pca-markers")
    people = stored(individual_index(calls), "pca-individuals")
    n, m = people.count(), markers.count()
    k = min(n_components, m)
    observed = cells(calls).where("dosage is not null").join(markers, "marker").join(people, "individual")
    entries = observed.select("row_idx", "marker_idx", ((F.col("dosage") - F.col("mean")) / F.col("std")).alias("z"))
    by_marker = m <= n
    rows = sparse_rows(entries, "row_idx", "marker_idx", "z") if by_marker else sparse_rows(entries, "marker_idx", "row_idx", "z")
    side = min(n, m)
    values, vectors, gaps = top_eigenpairs(stored(rows, "pca-rows"), side, min(k, side))
    values = np.maximum(values, 0) / max(n - 1, 1)
    if by_marker:
        vectors = vectors * np.where(vectors.sum(0) < 0, -1, 1)
        loadings = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "marker_idx long, loadings array<double>")
    else:
        # Loadings of the other side: Z'u / sqrt((n - 1) eigenvalue), one grouped pass over the entries.
        used = min(k, side)
        norm = np.sqrt(np.maximum(values * (n - 1), 1e-300))
        left = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors / norm)], "row_idx long, u array<double>")
        sums = entries.join(left, "row_idx").groupBy("marker_idx").agg(*[F.sum(F.col("z") * F.col("u")[c]).alias(f"c{c}") for c in range(used)])
        signs = sums.agg(*[F.when(F.sum(f"c{c}") < 0, -1.0).otherwise(1.0).alias(f"c{c}") for c in range(used)]).first()
        zero = [F.lit(0.0)] * (k - used)
        loadings = sums.select("marker_idx", F.array(*[F.col(f"c{c}") * signs[c] for c in range(used)], *zero).alias("loadings"))
        values, gaps = (np.concatenate([x, np.zeros(k - used)]) for x in (values, gaps))
    kept = markers if scale else markers.withColumn("mean", F.lit(0.0))
    model = stored(kept.join(loadings, "marker_idx").select("marker", "marker_idx", "mean", "std", "loadings"), "pca-model")
    found = [(i + 1, float(v), float(g)) for i, (v, g) in enumerate(zip(values, gaps, strict=True))]
    components = spark.createDataFrame(found, "component int, eigenvalue double, residual double")
    return PCAModel(model, components, k)


def scores(calls: DataFrame, markers: DataFrame, k: int) -> DataFrame:
    """(individual, scores) from the model's markers; markers are matched by name and missing calls add nothing."""
    z = cells(calls).join(markers, "marker").select("individual", ((F.col("dosage") - F.col("mean")) / F.col("std")).alias("z"), "loadings")
    sums = [F.coalesce(F.sum(F.col("z") * F.col("loadings")[c]), F.lit(0.0)) for c in range(k)]
    known = z.groupBy("individual").agg(F.array(*sums).alias("scores"))
    everyone = calls.select("individual").distinct()
    return everyone.join(known, "individual", "left").select("individual", F.coalesce("scores", F.array(*[F.lit(0.0)] * k)).alias("scores"))


def explained_variance(components: DataFrame, total: float | None = None) -> DataFrame:
    """(component, eigenvalue, ratio): shares of the extracted eigenvalues, or of ``total``; all 0 if that is 0."""
    whole = F.sum("eigenvalue").over(Window.partitionBy()) if total is None else F.lit(total)
    return components.select("component", "eigenvalue").withColumn("ratio", F.coalesce(F.try_divide("eigenvalue", whole), F.lit(0.0)))


def fit_transform(spark: SparkSession, calls: DataFrame, n_components: int = 10, scale: bool = True) -> tuple[PCAModel, DataFrame]:
    model = fit_pca(calls, n_components, scale)
    return model, scores(calls, model.markers, model.k)
