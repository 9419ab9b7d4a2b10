"""Tables that plots need: Manhattan points, PCA points, admixture bars (tree segments are in ``cluster``)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ranks import numbered


def manhattan(results: DataFrame, markers: DataFrame | None = None) -> DataFrame:
    """(position, marker, neg_log10): p <= 0 plots as 0.  Positions count the results in the order of
    ``markers(marker, marker_idx)``, or of their names without it."""
    height = F.when(F.col("pvalue") <= 0, 0.0).otherwise(-F.log10("pvalue"))
    points = results.select("marker", height.alias("neg_log10"))
    if markers is not None:
        points = points.join(markers.select("marker", "marker_idx"), "marker")
    return numbered(points, "position", "marker" if markers is None else "marker_idx").select("position", "marker", "neg_log10")


def pca_points(scores: DataFrame) -> DataFrame:
    """(individual, pc1, pc2, label); a single component has pc2 = 0."""
    points = scores.select("individual", F.col("scores")[0].alias("pc1"), F.coalesce(F.get("scores", F.lit(1)), F.lit(0.0)).alias("pc2"))
    return points.withColumn("label", F.format_string("%s<br>PC1: %.3f<br>PC2: %.3f", "individual", "pc1", "pc2"))


def admixture_bars(q: DataFrame) -> DataFrame:
    """(individual, cluster, proportion) with clusters called ``Cluster 1`` onwards."""
    long = q.select("individual", F.posexplode("q").alias("i", "proportion"))
    return long.select("individual", F.concat(F.lit("Cluster "), (F.col("i") + 1).cast("string")).alias("cluster"), "proportion")
