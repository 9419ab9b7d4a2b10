import math

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from genospark.functions.parsing import parse_value
from genospark.operators import calls as C
from genospark.operators import pheno, qc
from genospark.operators.ranks import numbered


def table(df, key, *columns):
    return {r[key]: tuple(r[c] for c in columns) for r in df.collect()}


def near(found, expected):
    assert found.keys() == expected.keys()
    for k, values in expected.items():
        assert found[k] == pytest.approx(values, abs=1e-9), k


def test_marker_metrics(calls):
    found = table(qc.compute_metrics(calls), "marker", "call_rate", "maf", "heterozygosity", "hwe_pvalue")
    near(found, {
        "M1": (1.0, 0.4, 0.4, 0.7093881150142262), "M2": (0.8, 0.5, 0.5, 1.0),
        "M3": (1.0, 0.5, 0.6, 0.654720846018577), "M4": (1.0, 0.4, 0.4, 0.7093881150142262),
    })


def test_default_filter_keeps_all_but_m2(calls):
    flags = qc.filter_markers(calls)
    kept = {r["marker"] for r in flags.where("keep").collect()}
    assert kept == {"M1", "M3", "M4"}
    assert [tuple(r) for r in qc.failing_markers(flags).collect()] == [("M2", "call_rate")]
    assert qc.apply_filter(calls, flags).select("individual").distinct().count() == 5


def test_column_statistics(calls):
    found = table(C.column_statistics(calls), "marker", "mean", "std")
    near(found, {"M1": (0.8, 0.8366600265), "M2": (1.0, 0.8164965809), "M3": (1.0, 0.7071067812), "M4": (0.8, 0.8366600265)})


def test_undefined_is_null_and_passes_thresholds(spark):
    rows = [("a", "none", None), ("b", "none", None), ("a", "mono", 0.0), ("b", "mono", 0.0)]
    df = spark.createDataFrame(rows, "individual string, marker string, dosage double")
    found = table(qc.filter_markers(df), "marker", "call_rate", "maf", "heterozygosity", "hwe_pvalue", "fail_call_rate", "fail_maf", "fail_hwe")
    assert found["none"] == (0.0, None, None, None, True, False, False)
    assert found["mono"] == (1.0, 0.0, 0.0, 1.0, False, True, False)


def test_absent_rows_count_as_missing(spark):
    df = spark.createDataFrame([("a", "x", 1.0), ("b", "x", 1.0), ("a", "y", 2.0)], "individual string, marker string, dosage double")
    assert table(C.call_rates(df), "marker", "call_rate") == {"x": (1.0,), "y": (0.5,)}


def test_half_even_rounding_and_odd_dosages(spark):
    df = spark.createDataFrame([(str(i), "m", v) for i, v in enumerate([0.5, 1.5, 2.5, 7.0, 1.0])], "individual string, marker string, dosage double")
    counts = df.groupBy("marker").agg(*qc._hwe_counts()).first()
    assert (counts["n0"], counts["n1"], counts["n2"]) == (1, 1, 2)


def test_grid_operators(calls, spark):
    imputed = {(r["individual"], r["marker"]): r["dosage"] for r in C.imputed_calls(calls).collect()}
    assert len(imputed) == 20 and imputed["I3", "M2"] == 1.0
    z = {(r["individual"], r["marker"]): r["z"] for r in C.standardized_calls(calls).collect()}
    assert z["I3", "M2"] == 0.0 and z["I1", "M3"] == pytest.approx(math.sqrt(2))
    raw = {(r["individual"], r["marker"]): r["z"] for r in C.standardized_calls(calls, impute=False).collect()}
    assert raw["I3", "M2"] == pytest.approx(-1 / 0.8164965809)
    order = spark.createDataFrame([(0, "M3"), (1, "nowhere")], "marker_idx long, marker string")
    moved = C.reorder_markers(calls, order).collect()
    assert len(moved) == 10 and all(r["dosage"] is None for r in moved if r["marker"] == "nowhere")


def test_parse_value(spark):
    df = spark.createDataFrame([(" 1.5 ",), ("",), ("NaN",), (" nan",), (None,)], "c string")
    assert [r[0] for r in df.select(parse_value(F.col("c"))).collect()] == [1.5, None, None, None, None]
    for bad in ("NA", "1.0d"):
        with pytest.raises(PySparkException):
            spark.createDataFrame([(bad,)], "c string").select(parse_value(F.col("c"))).collect()


def test_phenotype_summary(phenotypes):
    r = pheno.summary(phenotypes).first()
    found = (r["count"], r["mean"], r["std"], r["min"], r["q25"], r["q50"], r["q75"], r["max"])
    assert found == pytest.approx((5, 11.92, 1.0616025622, 10.5, 11.2, 12.1, 12.8, 13.0))


@pytest.mark.parametrize("n", range(1, 10))
def test_quartiles_by_position(spark, n):
    values = sorted((i * 7 % 11) / 2 for i in range(n))
    r = pheno.summary(spark.createDataFrame([("x", v) for v in values], "individual string, value double")).first()
    assert (r["q25"], r["q75"]) == (values[n // 4], values[3 * n // 4])


def test_phenotype_errors_and_normalisation(spark, phenotypes):
    z = [r["z"] for r in pheno.normalize(phenotypes).collect()]
    assert sum(z) == pytest.approx(0, abs=1e-9) and sum(v * v for v in z) / 4 == pytest.approx(1)
    flat = spark.createDataFrame([("a", 1.0), ("b", 1.0)], "individual string, value double")
    for call in (lambda: pheno.normalize(flat), lambda: pheno.summary(flat.where("false"))):
        with pytest.raises(PySparkException):
            call().collect()


def test_last_value_wins_and_subset_keeps_repeats(spark):
    df = spark.createDataFrame([("a", 1.0, 0), ("a", 2.0, 1), ("b", 3.0, 2)], "individual string, value double, row_idx long")
    wanted = spark.createDataFrame([("a",), ("a",), ("z",)], "individual string")
    assert sorted(tuple(r) for r in pheno.subset(df, wanted).collect()) == [("a", 2.0), ("a", 2.0)]


def test_folds_are_disjoint_and_even(spark):
    df = spark.createDataFrame([(f"I{i}",) for i in range(11)], "individual string")
    sizes = [r["count"] for r in pheno.assign_folds(df, 4, 1).groupBy("fold").count().orderBy("fold").collect()]
    assert sizes == [3, 3, 3, 2]


def test_correlation_of_a_constant_is_null(spark):
    rows = [("flat", 1.0, 2.0), ("flat", 1.0, 3.0), ("one", 1.0, 1.0), ("line", 1.0, 2.0), ("line", 2.0, 4.0), ("line", None, 9.0)]
    df = spark.createDataFrame(rows, "k string, x double, y double")
    found = table(df.groupBy("k").agg(pheno.pearson("x", "y").alias("r")), "k", "r")
    assert found == {"flat": (None,), "one": (None,), "line": (pytest.approx(1.0),)}


def test_numbered_positions(spark):
    rows = spark.createDataFrame([(f"x{i * 37 % 100:03}", i) for i in range(100)], "name string, v int")
    found = numbered(rows, "at", "name").collect()
    assert sorted((r["at"], r["name"]) for r in found) == [(i, f"x{i:03}") for i in range(100)]
    tied = numbered(rows.withColumn("same", F.lit(1)), "at", "same")
    assert sorted(r["at"] for r in tied.collect()) == list(range(100))
    assert numbered(rows.where("false"), "at", "name").count() == 0


def test_phenotypes_align_to_genotypes(spark, calls, phenotypes):
    more = phenotypes.union(spark.createDataFrame([("I9", 1.0, 7), ("I1", 99.0, 8)], phenotypes.schema))
    found = {r["individual"]: r["value"] for r in pheno.align(more, calls).collect()}
    assert found["I1"] == 99.0 and len(found) == 5 and "I9" not in found


def test_a_grid_of_many_blocks_is_whole(calls, monkeypatch):
    whole = {tuple(r) for r in C.imputed_calls(calls).collect()}
    monkeypatch.setattr(C, "GRID_BLOCK", 2)
    assert {tuple(r) for r in C.imputed_calls(calls).collect()} == whole and len(whole) == 20
    monkeypatch.setattr(C, "GRID_BROADCAST", 1)  # blocks met by parts of the individuals
    assert {tuple(r) for r in C.imputed_calls(calls).collect()} == whole
