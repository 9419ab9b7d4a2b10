"""The six workloads: read tables, compute, write results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import admixture, calls as C, cluster, gblup, gwas, pca, plotdata, qc
from ..sources.files import array_columns, check_calls, write_csv, write_matrix, write_parquet
from ..storage import stored


def run_qc(calls: DataFrame, out: str, maf: float = 0.01, call_rate: float = 0.95, hwe_p: float = 1e-6) -> DataFrame:
    """Writes ``metrics`` (CSV), ``genotypes`` (parquet, long) and ``matrix`` (text, ``id`` and the kept markers, all
    individuals; both in their order) and returns the flags."""
    calls = check_calls(calls)
    flags = stored(qc.filter_markers(calls, maf, call_rate, hwe_p), "qc-flags")
    write_csv(flags.select("marker", "call_rate", "maf", "heterozygosity", "hwe_pvalue"), f"{out}/metrics")
    kept = qc.apply_filter(calls, flags)
    write_parquet(kept, f"{out}/genotypes")
    write_matrix(kept, f"{out}/matrix", everyone=calls)
    return flags


def run_gwas(calls: DataFrame, phenotypes: DataFrame, out: str, cov: DataFrame | None = None, min_call_rate: float = 0.9, impute: bool = True) -> DataFrame:
    results = gwas.gwas(check_calls(calls), phenotypes, cov, min_call_rate, impute)
    write_csv(results, f"{out}/gwas")
    order = C.marker_index(calls) if "marker_idx" in calls.columns else None
    write_csv(plotdata.manhattan(results.where("status = 'ok'"), order), f"{out}/manhattan")
    return results


def run_pca(spark: SparkSession, calls: DataFrame, out: str, n_components: int = 10, scale: bool = True) -> DataFrame:
    calls = check_calls(calls)
    model, points = pca.fit_transform(spark, calls, n_components, scale)
    write_csv(array_columns(points, "scores", [f"PC{i + 1}" for i in range(model.k)]), f"{out}/scores")
    shares = pca.explained_variance(model.components).select("component", F.col("ratio").alias("explained_variance_ratio"))
    write_csv(shares, f"{out}/variance", single_file=True)
    return points


def run_gblup(calls: DataFrame, phenotypes: DataFrame, out: str, alpha: float = 1e-3, scale: bool = True, n_splits: int = 5, seed: int = 0) -> DataFrame:
    calls = check_calls(calls)
    model = gblup.fit_gblup(calls, phenotypes, alpha, scale)
    predictions = gblup.predict(calls, model.markers, model.intercept)
    write_csv(predictions, f"{out}/predictions")
    metrics, _ = gblup.cross_validate(calls, phenotypes, n_splits, alpha, scale, seed)
    write_csv(metrics, f"{out}/cross_validation", single_file=True)
    return predictions


def run_dendrogram(calls: DataFrame, out: str, linkage: str = "average") -> DataFrame:
    calls = check_calls(calls)
    merges = cluster.named_merges(cluster.dendrogram(calls, linkage), calls)
    write_csv(merges, f"{out}/merges", single_file=True)  # they come in order of their steps
    return merges


def run_admixture(calls: DataFrame, out: str, n_populations: int, max_iter: int = 500, tol: float = 1e-4, seed: int = 0) -> DataFrame:
    q, p, _ = admixture.fit_admixture(check_calls(calls), n_populations, max_iter, tol, seed)
    names = [f"cluster_{i + 1}" for i in range(n_populations)]
    write_csv(array_columns(q, "q", names), f"{out}/proportions")
    write_csv(array_columns(p, "p", names), f"{out}/alleles")
    return q

