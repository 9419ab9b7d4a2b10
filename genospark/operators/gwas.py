"""Marker-wise association: y = b0 + covariates + b * dosage for each marker.

One grouped pass sums what the normal equations need, on centred phenotypes and covariates; designs are never built.
Small batched solves then run over the markers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.tails import t_two_tailed

SCHEMA = "marker string, effect double, se double, t double, pvalue double, n double, status string"
#: A marker whose spread, beyond what covariates explain, is below this share of its sum of squares is singular.
SINGULAR = 1e-10


def _samples(calls: DataFrame, pheno: DataFrame, cov: DataFrame | None) -> tuple[DataFrame, list[str]]:
    """(individual, y, z0, z1, ...), centred, for individuals with calls, a phenotype and all covariates."""
    table = pheno.where("value is not null").select("individual", F.col("value").alias("y"))
    names: list[str] = []
    if cov is not None:
        columns = [c for c in cov.columns if c != "individual"]
        names = [f"z{i}" for i in range(len(columns))]
        table = table.join(cov.select("individual", *[F.col(c).cast("double").alias(n) for c, n in zip(columns, names, strict=True)]), "individual")
    table = table.join(calls.select("individual").distinct(), "individual", "left_semi")
    means = table.agg(F.struct(*[F.avg(c).alias(c) for c in ("y", *names)]).alias("m")).scalar()
    told = table.withColumn("_m", means)
    return told.select("individual", *[(F.col(c) - F.col(f"_m.{c}")).alias(c) for c in ("y", *names)]), names


def dropped_individuals(calls: DataFrame, pheno: DataFrame, cov: DataFrame) -> DataFrame:
    """Phenotyped individuals with calls that a missing covariate row drops."""
    return pheno.select("individual").join(calls.select("individual").distinct(), "individual", "left_semi").join(cov, "individual", "left_anti")


def gwas(calls: DataFrame, pheno: DataFrame, cov: DataFrame | None = None, min_call_rate: float = 0.9, impute: bool = True) -> DataFrame:
    """(marker, effect, se, t, pvalue, n, status) for markers whose call rate among the aligned is high enough.

    With ``impute`` missing calls are the marker's mean and count in n; without, they drop out.  ``status`` is ok,
    singular (no spread) or insufficient (n at most the number of coefficients); the latter two have null statistics.
    """
    samples, names = _samples(calls, pheno, cov)
    all_z = ("y", *names)
    product = lambda a, b: F.sum(F.col(a) * F.col(b))
    pairs = [(a, b) for i, a in enumerate(all_z) for b in all_z[i:]]
    totals = samples.agg(
        F.struct(F.count(F.lit(1)).alias("n"), *[product(a, b).alias(f"{a}_{b}") for a, b in pairs]).alias("t")
    ).scalar()
    observed = calls.select("individual", "marker", "dosage").where("dosage is not null").join(samples, "individual").withColumn("g", F.col("dosage"))
    sums = [F.count("g").alias("n"), F.sum("g").alias("g"), product("g", "g").alias("gg")]
    sums += [product("g", c).alias(f"g_{c}") for c in all_z] + [F.sum(c).alias(f"s_{c}") for c in all_z]
    if not impute:  # then the products of y and covariates depend on the called rows
        sums += [product(a, b).alias(f"{a}_{b}") for a, b in pairs]
    per_marker = observed.groupBy("marker").agg(*sums).withColumn("t", totals)
    called = per_marker.where(F.col("n") / F.col("t.n") >= min_call_rate)
    source = "t." if impute else ""
    flat = called.select(
        "marker", F.col("n").cast("double").alias("n"), F.col("t.n").cast("double").alias("total"), "g", "gg",
        F.array(*[F.col(f"g_{c}") for c in all_z]).alias("gz"), F.array(*[F.col(f"s_{c}") for c in all_z]).alias("sz"),
        F.array(*[F.col(f"{source}{a}_{b}") for a, b in pairs]).alias("zz"),
    )
    return flat.mapInArrow(_solver(len(names), impute), SCHEMA)


def _solver(n_cov: int, impute: bool):
    upper = [(i, j) for i in range(n_cov + 1) for j in range(i, n_cov + 1)]

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k = batch.num_rows
            if not k:
                continue
            n, total, g, gg = (batch.column(c).to_numpy(zero_copy_only=False).copy() for c in ("n", "total", "g", "gg"))
            gz, sz, zz = (np.array(batch.column(c).to_pylist()).reshape(k, -1) for c in ("gz", "sz", "zz"))
            if impute:
                mean, missing = g / n, total - n
                g, gg = total * mean, gg + missing * mean**2
                gz, sz, n = gz - mean[:, None] * sz, np.zeros_like(sz), total
            products = np.zeros((k, n_cov + 1, n_cov + 1))
            for at, (i, j) in enumerate(upper):
                products[:, i, j] = products[:, j, i] = zz[:, at]
            # About the means of the rows that count: the intercept drops out.
            cross = products - sz[:, :, None] * sz[:, None, :] / n[:, None, None]
            with_g = gz - (g / n)[:, None] * sz
            spread = gg - g * g / n
            p = n_cov + 2
            # The part of g and y that covariates explain.
            explained_g, explained_y, gy = np.zeros(k), np.zeros(k), with_g[:, 0].copy()
            status = np.where(n <= p, "insufficient", "ok").astype(object)
            if n_cov:
                block = cross[:, 1:, 1:]
                singular = np.abs(np.linalg.det(block)) <= 1e-12 * np.maximum(np.prod(np.diagonal(block, axis1=1, axis2=2), axis=1), 1e-300)
                status[(status == "ok") & singular] = "singular"
                block = np.where((singular | (n <= p))[:, None, None], np.eye(n_cov), block)
                coefficient = np.linalg.solve(block, np.stack([with_g[:, 1:], cross[:, 0, 1:]], 2))
                explained_g = (with_g[:, 1:] * coefficient[:, :, 0]).sum(1)
                explained_y = (cross[:, 0, 1:] * coefficient[:, :, 1]).sum(1)
                gy = gy - (cross[:, 0, 1:] * coefficient[:, :, 0]).sum(1)
            sxx = spread - explained_g
            syy = cross[:, 0, 0] - explained_y
            status[(status == "ok") & (sxx <= SINGULAR * gg)] = "singular"
            ok = status == "ok"
            with np.errstate(divide="ignore", invalid="ignore"):
                effect = gy / sxx
                df = n - p
                rss = np.maximum(syy - gy * gy / sxx, 0)
                rss[rss <= 1e-14 * syy] = 0
                se = np.sqrt(rss / df / sxx)
                t = np.where(se > 0, effect / se, 0.0)
            pvalue = t_two_tailed(np.where(ok, t, np.nan), df)
            values = [pa.array(np.where(ok, v, np.nan), from_pandas=True) for v in (effect, se, t, pvalue)]
            yield pa.record_batch([batch.column("marker"), *values, pa.array(n), pa.array(status.tolist())], names=["marker", "effect", "se", "t", "pvalue", "n", "status"])

    return solve
