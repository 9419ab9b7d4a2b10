"""Ridge regression on markers (GBLUP): fit, predict, cross-validate."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import discard, stored
from . import linalg
from .calls import cells, imputed_calls, individual_index, marker_index
from .linalg import collect_gram, gram, gram_times, solve_ridge, sparse_rows
from .pheno import assign_folds, pearson, rmse


@dataclass
class RidgeModel:
    """``markers(marker, marker_idx, mean, scale, effect)`` and the intercept, the mean of the phenotype."""

    markers: DataFrame
    intercept: float


def _aligned(calls: DataFrame, pheno: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Calls of phenotyped individuals, and (individual, row_idx, y)."""
    known = pheno.where("value is not null").select("individual", "value")
    own = calls.join(known.select("individual"), "individual", "left_semi")
    samples = individual_index(own).join(known, "individual").select("individual", "row_idx", F.col("value").alias("y"))
    return own, stored(samples, "gblup-samples")


def _marker_table(calls: DataFrame, scale: bool) -> DataFrame:
    """Means and standard deviations after imputation: an imputed cell adds no square but counts."""
    n = calls.agg(F.countDistinct("individual").alias("n")).scalar()
    mean = F.coalesce(F.avg("dosage"), F.lit(0.0))
    grouped = calls.groupBy("marker").agg(mean.alias("mean"), F.coalesce(F.var_pop("dosage") * F.count("dosage"), F.lit(0.0)).alias("ss"))
    std = F.sqrt(F.try_divide(F.col("ss"), n - 1))
    out = grouped.select("marker", "mean", F.when(std > 0, std).otherwise(1.0).alias("scale"))
    if not scale:
        out = out.withColumn("scale", F.lit(1.0))
    return out.join(marker_index(calls), "marker")


def _table(spark: SparkSession, values: np.ndarray, index: str, name: str) -> DataFrame:
    return spark.createDataFrame(pa.table({index: pa.array(np.arange(len(values))), name: pa.array(values)}))


def normal_equations(calls: DataFrame, pheno: DataFrame, scale: bool = True) -> tuple[DataFrame, DataFrame]:
    """X'X as (mi, mj, v) for mi <= mj and X'y as (m, v), for few markers: the plain form that ``fit`` must equal."""
    own, samples = _aligned(calls, pheno)
    markers = _marker_table(own, scale)
    z = (
        cells(own).where("dosage is not null").join(markers, "marker").join(samples, "individual")
        .select("individual", "y", F.col("marker_idx").alias("m"), ((F.col("dosage") - F.col("mean")) / F.col("scale")).alias("z"))
    )
    a, b = (z.select("individual", F.col("m").alias(f"m{s}"), F.col("z").alias(f"z{s}")) for s in "ij")
    xtx = a.join(b, "individual").where("mi <= mj").groupBy("mi", "mj").agg(F.sum(F.col("zi") * F.col("zj")).alias("v"))
    return xtx, z.groupBy("m").agg(F.sum(F.col("z") * F.col("y")).alias("v"))


def fit_gblup(calls: DataFrame, pheno: DataFrame, alpha: float = 1e-3, scale: bool = True) -> RidgeModel:
    """Effects (X'X + alpha I)^-1 X'y, or X'(XX' + alpha I)^-1 y when there are fewer individuals than markers.

    Sides up to ``linalg.MAX_SIDE`` are solved on the driver, larger ones by conjugate gradients over the stored rows.
    X is imputed by means and, with ``scale``, standardised; y is not centred.  Without ``scale`` X is not centred
    either, so the intercept that ``predict`` adds counts twice, as it does in the method followed here.
    """
    spark = calls.sparkSession
    own, samples = _aligned(calls, pheno)
    markers = stored(_marker_table(own, scale), "gblup-markers")
    facts = samples.agg(F.count(F.lit(1)).alias("n"), F.avg("y").alias("mean")).first()
    n, m = facts["n"], markers.count()
    if not n or not m:
        raise ValueError("no individual has both calls and a phenotype")
    shift = F.col("mean") if scale else F.lit(0.0)
    joined = cells(own).where("dosage is not null").join(markers, "marker").join(samples, "individual")
    entries = joined.select("row_idx", "marker_idx", "y", ((F.col("dosage") - shift) / F.col("scale")).alias("z"))
    if not scale:  # missing calls are means, which are not 0 here: the grid is written out
        every = imputed_calls(own).join(markers.select("marker", "marker_idx"), "marker")
        entries = every.join(samples, "individual").select("row_idx", "marker_idx", "y", F.col("dosage").alias("z"))
    side = min(m, n)
    rows = stored(sparse_rows(entries, *(("row_idx", "marker_idx") if m <= n else ("marker_idx", "row_idx")), "z"), "gblup-rows")
    right = np.zeros(side)
    if m <= n:
        for row in entries.groupBy("marker_idx").agg(F.sum(F.col("z") * F.col("y")).alias("v")).toArrow().to_pylist():
            right[row["marker_idx"]] = row["v"]
    else:
        found = samples.select("row_idx", "y").toArrow()  # the smaller side
        right[found["row_idx"].to_numpy()] = found["y"].to_numpy()
    if side <= linalg.MAX_SIDE:
        solved = np.linalg.solve(collect_gram(gram(rows, side), side) + alpha * np.eye(side), right)
    else:
        solved = solve_ridge(lambda x: gram_times(rows, x), right[:, None], alpha)[:, 0]
    discard(rows)
    if m <= n:
        effects = _table(spark, solved, "marker_idx", "effect")
    else:
        weights = _table(spark, solved, "row_idx", "w")
        effects = entries.join(weights, "row_idx").groupBy("marker_idx").agg(F.sum(F.col("z") * F.col("w")).alias("effect"))
    model = markers.withColumn("mean", shift).join(effects, "marker_idx", "left").withColumn("effect", F.coalesce("effect", F.lit(0.0)))
    return RidgeModel(stored(model.select("marker", "marker_idx", "mean", "scale", "effect"), "gblup-model"), float(facts["mean"]))


def predict(calls: DataFrame, markers: DataFrame, intercept: float) -> DataFrame:
    """(individual, prediction): intercept + sum of effect * (dosage - mean) / scale.

    A missing call is the mean of the *new* calls; a marker that they lack wholly has the value 0.  The sum over
    missing cells is taken from the marker's totals, so the grid is not built.
    """
    new = calls.groupBy("marker").agg(F.coalesce(F.avg("dosage"), F.lit(0.0)).alias("new_mean"))
    model = markers.join(new, "marker", "left").select(
        "marker", "mean", "scale", "effect", F.coalesce("new_mean", F.lit(0.0)).alias("new_mean")
    )
    # As if every call were missing, then the difference of each observed call.
    base = model.agg(F.coalesce(F.sum(F.col("effect") * (F.col("new_mean") - F.col("mean")) / F.col("scale")), F.lit(0.0)).alias("b")).scalar()
    moved = calls.where("dosage is not null").join(model, "marker").groupBy("individual").agg(
        F.sum(F.col("effect") * (F.col("dosage") - F.col("new_mean")) / F.col("scale")).alias("d")
    )
    everyone = calls.select("individual").distinct()
    return everyone.join(moved, "individual", "left").select("individual", (F.lit(intercept) + base + F.coalesce("d", F.lit(0.0))).alias("prediction"))


def cross_validate(
    calls: DataFrame, pheno: DataFrame, n_splits: int = 5, alpha: float = 1e-3, scale: bool = True, seed: int = 0, folds: DataFrame | None = None
) -> tuple[DataFrame, DataFrame]:
    """Metrics (fold, rmse, correlation, n_test) and predictions (individual, fold, y, prediction).

    Means for imputation come from all folds; standardisation comes from the training folds.  ``folds(individual,
    fold)`` replaces the hash.  With fewer markers than individuals, one pass sums moments by fold and training moments
    are the totals without a fold's own; with fewer individuals, one pass sums their products under each fold's
    standardisation.  Where both sides are over ``linalg.MAX_SIDE``, all folds are solved
    together by conjugate gradients, a pass each step.
    """
    own, samples = _aligned(calls, pheno)
    given = assign_folds(samples, n_splits, seed) if folds is None else samples.join(folds.select("individual", "fold"), "individual")
    placed = stored(given.select("individual", "row_idx", "y", F.col("fold").cast("int").alias("fold")), "cv-samples")
    markers = stored(_marker_table(own, scale), "cv-markers")
    n, m = placed.count(), markers.count()
    centred = stored(
        cells(own).where("dosage is not null").join(markers, "marker").join(placed, "individual")
        .select("individual", "row_idx", "fold", "y", "marker_idx", (F.col("dosage") - F.col("mean")).alias("c")), "cv-entries",
    )
    dual = n < m and n <= linalg.MAX_SIDE
    predicted = (_by_individuals if dual else _by_markers)(centred, placed, markers, m, alpha, scale)
    predictions = stored(placed.join(predicted, "individual").select("individual", "fold", "y", "prediction"), "cv-predictions")
    discard(centred)
    return fold_metrics(predictions), predictions


def _by_markers(centred: DataFrame, placed: DataFrame, markers: DataFrame, m: int, alpha: float, scale: bool) -> DataFrame:
    """(individual, prediction), each from the effects that the other folds give."""
    spark = placed.sparkSession
    sums, cy, squares = {}, {}, {}
    moments = centred.groupBy("fold", "marker_idx").agg(F.sum("c").alias("s"), F.sum(F.col("c") * F.col("y")).alias("cy"), F.sum(F.col("c") * F.col("c")).alias("cc")).toArrow()
    fold_of = moments["fold"].to_numpy()
    for fold in np.unique(fold_of):
        at = fold_of == fold
        for table, name in ((sums, "s"), (cy, "cy"), (squares, "cc")):
            table[int(fold)] = np.zeros(m)
            table[int(fold)][moments["marker_idx"].to_numpy()[at]] = moments[name].to_numpy()[at]
    sizes = {r["fold"]: (r["n"], r["y"]) for r in placed.groupBy("fold").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("y")).collect()}
    found = markers.select("marker_idx", "mean").toArrow()
    means = np.zeros(m)
    means[found["marker_idx"].to_numpy()] = found["mean"].to_numpy()
    rows = stored(sparse_rows(centred, "row_idx", "marker_idx", "c", key="fold"), "cv-rows")
    small = m <= linalg.MAX_SIDE
    grams = stored(gram(rows, m, keyed=True), "cv-grams") if small else None
    whole = sum((collect_gram(grams.where(F.col("key") == f), m) for f in sizes), np.zeros((m, m))) if small else None
    none, solved, large = np.zeros(m), {}, {}
    for fold, (own_n, own_y) in sizes.items():
        n, y_sum = sum(v[0] for v in sizes.values()) - own_n, sum(v[1] for v in sizes.values()) - own_y
        if not n:
            continue
        s, b, cc = (sum(t.values(), none) - t.get(fold, none) for t in (sums, cy, squares))
        if scale:
            std = np.sqrt(np.maximum(cc - s * s / n, 0) / max(n - 1, 1))
            std[std <= 1e-12] = 1.0
            shift, right = s / n, (b - s / n * y_sum) / std
        else:  # raw dosages: centred ones plus the overall mean
            std, shift, right = np.ones(m), -means, b + means * y_sum
        if small:
            g = whole - collect_gram(grams.where(F.col("key") == fold), m)
            xtx = g - np.outer(s, shift) - np.outer(shift, s) + n * np.outer(shift, shift)
            solved[fold] = (np.linalg.solve(xtx / np.outer(std, std) + alpha * np.eye(m), right), std, shift, y_sum / n)
        else:
            large[fold] = (s, shift, std, right, n, y_sum / n)
    if large:  # all folds together: a column each, which leaves out the fold's own rows
        folds = np.array(list(large))
        s, shift, std, right, n, _ = (np.array(x).T for x in zip(*large.values(), strict=True))

        def times(p: np.ndarray) -> np.ndarray:
            q = p / std
            sq, hq = (s * q).sum(0), (shift * q).sum(0)
            return (gram_times(rows, q, skip=folds) - s * hq - shift * sq + n * shift * hq) / std

        beta = solve_ridge(times, right, alpha)
        solved = {f: (beta[:, c], large[f][2], large[f][1], large[f][5]) for c, f in enumerate(large)}
    out = []
    for fold, (beta, std, shift, y_mean) in solved.items():
        w = _table(spark, beta / std, "marker_idx", "w")
        moved = centred.where(F.col("fold") == fold).join(w, "marker_idx").groupBy("individual").agg(F.sum(F.col("c") * F.col("w")).alias("d"))
        base = float(y_mean - (shift * beta / std).sum())
        tested = placed.where(F.col("fold") == fold).select("individual").join(moved, "individual", "left")
        out.append(tested.select("individual", (F.lit(base) + F.coalesce("d", F.lit(0.0))).alias("prediction")))
    return reduce(DataFrame.union, out)


def _by_individuals(centred: DataFrame, placed: DataFrame, markers: DataFrame, m: int, alpha: float, scale: bool) -> DataFrame:
    """The same from products of individuals: (K + alpha I)^-1 y of the training folds, for each fold's own K."""
    spark = placed.sparkSession
    people = placed.select("individual", "row_idx", "fold", "y").toArrow()
    place = {int(r): i for i, r in enumerate(people["row_idx"].to_numpy())}
    numbers = spark.createDataFrame(pa.table({"row_idx": pa.array(list(place)), "i": pa.array(list(place.values()))}))
    fold_of, y = people["fold"].to_numpy(), people["y"].to_numpy()
    own = centred.groupBy("fold", "marker_idx").agg(F.sum("c").alias("s"), F.sum(F.col("c") * F.col("c")).alias("cc"))
    every = own.groupBy("marker_idx").agg(F.sum("s").alias("all_s"), F.sum("cc").alias("all_cc"))
    held = [F.struct(F.lit(int(f)).alias("fold"), F.lit(int((fold_of != f).sum())).alias("n")) for f in np.unique(fold_of)]
    stats = every.withColumn("f", F.explode(F.array(*held))).select("marker_idx", "all_s", "all_cc", "f.fold", "f.n").where("n > 0")
    stats = stats.join(own, ["fold", "marker_idx"], "left").join(markers.select("marker_idx", "mean"), "marker_idx")
    s, cc = F.col("all_s") - F.coalesce("s", F.lit(0.0)), F.col("all_cc") - F.coalesce("cc", F.lit(0.0))
    std = F.sqrt(F.greatest(cc - s * s / F.col("n"), F.lit(0.0)) / F.greatest(F.col("n") - 1, F.lit(1)))
    shift = s / F.col("n") if scale else -F.col("mean")
    stats = stats.select("marker_idx", F.col("fold").alias("key"), shift.alias("shift"), (F.when(std > 1e-12, std).otherwise(1.0) if scale else F.lit(1.0)).alias("std"))
    entries = centred.join(numbers, "row_idx").join(stats, "marker_idx")
    entries = entries.select("marker_idx", "key", "i", ((F.col("c") - F.col("shift")) / F.col("std")).alias("z"), (-F.col("shift") / F.col("std")).alias("fill"))
    grams = stored(gram(sparse_rows(entries, "marker_idx", "i", "z", key="key", fill="fill"), len(y), keyed=True), "cv-grams")
    prediction = np.zeros(len(y))
    for fold in np.unique(fold_of):
        train, test = np.flatnonzero(fold_of != fold), np.flatnonzero(fold_of == fold)
        if not len(train):
            continue
        k = collect_gram(grams.where(F.col("key") == int(fold)), len(y))
        weights = np.linalg.solve(k[np.ix_(train, train)] + alpha * np.eye(len(train)), y[train])
        prediction[test] = y[train].mean() + k[np.ix_(test, train)] @ weights
    return spark.createDataFrame(pa.table({"individual": people["individual"], "prediction": pa.array(prediction)}))


def fold_metrics(predictions: DataFrame) -> DataFrame:
    """(fold, rmse, correlation, n_test) from (fold, y, prediction)."""
    return predictions.groupBy("fold").agg(
        rmse("y", "prediction").alias("rmse"), pearson("y", "prediction").alias("correlation"), F.count(F.lit(1)).alias("n_test")
    )
