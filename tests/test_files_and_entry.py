import csv

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

import __spark_entry__
from genospark.operators import plotdata
from genospark.operators.calls import individual_index, marker_index
from genospark.plans import jobs
from genospark.sources import files

GENOTYPES = "M1,id,M2,M3\n0,I1,1,\n1, I2 ,nan,2\n2,I3, ,0\n"


@pytest.fixture
def path(tmp_path):
    def write(name, text):
        (tmp_path / name).write_text(text)
        return str(tmp_path / name)

    return write


def test_read_genotypes(spark, path):
    file = path("g.csv", GENOTYPES)
    expected = {("I1", "M1", 0.0), ("I1", "M2", 1.0), ("I1", "M3", None), (" I2 ", "M1", 1.0), (" I2 ", "M2", None), (" I2 ", "M3", 2.0),
                ("I3", "M1", 2.0), ("I3", "M2", None), ("I3", "M3", 0.0)}
    for wide in (4000, 2):
        found = files.read_genotypes(spark, file, "id", wide=wide)
        assert {tuple(r)[:3] for r in found.collect()} == expected
        assert [r["individual"] for r in individual_index(found).orderBy("row_idx").collect()] == ["I1", " I2 ", "I3"]
        assert {r["marker"]: r["marker_idx"] for r in found.collect()} == {"M1": 0, "M2": 1, "M3": 2}


@pytest.mark.parametrize("wide", [2, 4000])
def test_both_ways_of_reading_agree(spark, path, wide):
    file = path("odd.csv", 'id,M1,M2,M3\nI1,"1",\t,2\n\nI2, 0 ,NaN\nI3,1,2,0,9\n')
    found = {(r["individual"], r["marker"]): r["dosage"] for r in files.read_genotypes(spark, file, wide=wide).collect()}
    assert [found["I1", f"M{i}"] for i in (1, 2, 3)] == [1.0, None, 2.0]
    assert [found["I2", f"M{i}"] for i in (1, 2, 3)] == [0.0, None, None]
    assert [found["I3", f"M{i}"] for i in (1, 2, 3)] == [1.0, 2.0, 0.0]
    for bad in ("1_0", "1.0d", "x"):
        with pytest.raises(PySparkException):
            files.read_genotypes(spark, path("bad.csv", f"id,M1,M2,M3\nI1,{bad},1,1\n"), wide=wide).collect()


def test_reading_errors(spark, path):
    with pytest.raises(ValueError, match="no column"):
        files.read_genotypes(spark, path("a.csv", GENOTYPES), "nowhere")
    with pytest.raises(ValueError, match="repeats"):
        files.read_genotypes(spark, path("b.csv", "id,M,M\nI1,0,1\n"))
    with pytest.raises(PySparkException):
        files.read_genotypes(spark, path("c.csv", "id,M\nI1,NA\n")).collect()
    with pytest.raises(PySparkException):
        files.read_covariates(spark, path("d.csv", "id,c\nI1,\n")).collect()


def test_phenotypes_and_covariates(spark, path):
    p = files.read_phenotypes(spark, path("p.csv", "id;a;b\nI1;1;2\nI2;;3\n"), "a", delimiter=";").collect()
    assert [(r["individual"], r["value"]) for r in p] == [("I1", 1.0)]
    c = files.read_covariates(spark, path("c.csv", "id,x\nI1,1\nI1,2\n")).collect()
    assert [tuple(r) for r in c] == [("I1", 2.0)]


def test_matrix_sink_and_jobs(spark, calls, phenotypes, covariates, tmp_path):
    wide = files.genotype_matrix(calls, ["M2", "M1"])
    assert wide.columns == ["id", "M2", "M1"]
    files.write_csv(wide, str(tmp_path / "wide"), single_file=True)
    (part,) = (tmp_path / "wide").glob("part-*.csv")
    rows = {r["id"]: r for r in csv.DictReader(part.open())}
    assert rows["I3"]["M2"] == "" and rows["I3"]["M1"] == "2.0"
    jobs.run_qc(calls, str(tmp_path / "qc"))
    assert spark.read.parquet(str(tmp_path / "qc/genotypes")).count() == 15
    lines = [r[0] for r in spark.read.text(str(tmp_path / "qc/matrix")).collect()]
    assert sorted(lines)[-1] == "id,M1,M3,M4" and len(lines) == 6 and "I3,2.0,0.0,1.0" in lines
    assert jobs.run_gwas(calls, phenotypes, str(tmp_path / "gwas"), covariates).count() == 3
    jobs.run_pca(spark, calls, str(tmp_path / "pca"), 2)
    assert spark.read.csv(str(tmp_path / "pca/variance"), header=True).columns == ["component", "explained_variance_ratio"]
    jobs.run_gblup(calls, phenotypes, str(tmp_path / "gblup"), n_splits=3)
    jobs.run_dendrogram(calls, str(tmp_path / "tree"))
    jobs.run_admixture(calls, str(tmp_path / "admixture"), 2, max_iter=3)
    assert spark.read.csv(str(tmp_path / "tree/merges"), header=True).columns == ["step", "left", "right", "distance"]
    assert spark.read.csv(str(tmp_path / "admixture/proportions"), header=True).columns == ["individual", "cluster_1", "cluster_2"]


def test_quoted_line_breaks(spark, path):
    file = path("q.csv", 'id,M1,M2\n"a\nb",1,2\n"c ""x""",0,\nd,"1\n",0\n')
    found = {(r["individual"], r["marker"]): r["dosage"] for r in files.read_genotypes(spark, file).collect()}
    assert found == {("a\nb", "M1"): 1.0, ("a\nb", "M2"): 2.0, ('c "x"', "M1"): 0.0, ('c "x"', "M2"): None, ("d", "M1"): 1.0, ("d", "M2"): 0.0}
    with pytest.raises(PySparkException, match="line break inside quotes"):
        files.read_genotypes(spark, file, wide=2).collect()


def test_matrix_of_many_markers_keeps_its_order(spark, tmp_path):
    """20,000 markers and 40 individuals in an order that is not that of their names, and one individual without a call."""
    m = 20_000
    calls = spark.range(40 * m).selectExpr(
        f"concat('I', 39 - id div {m}) as individual", f"concat('M', id % {m} * 7919 % {m}) as marker",
        f"if(id % 11 = 0 or id div {m} = 3, null, cast(id % 3 as double)) as dosage", f"id div {m} as row_idx", f"id % {m} as marker_idx",
    )
    files.write_matrix(calls, str(tmp_path / "m"))
    back = files.read_genotypes(spark, str(tmp_path / "m"), "id")
    assert back.count() == 40 * m
    order = individual_index(back).withColumnRenamed("row_idx", "r")
    same = back.join(order, "individual").alias("x").join(calls.alias("y"), ["individual", "marker"])
    assert same.where("x.dosage <=> y.dosage and x.marker_idx = y.marker_idx and x.r = y.row_idx").count() == 40 * m


def test_indices_follow_the_file(spark):
    rows = [("b", "M10", 1.0, 5, 3), ("a", "M10", 0.0, 9, 3), ("b", "M9", 2.0, 5, 8), ("a", "M9", 1.0, 9, 8)]
    calls = spark.createDataFrame(rows, "individual string, marker string, dosage double, row_idx long, marker_idx long")
    assert [tuple(r) for r in individual_index(calls).orderBy("row_idx").collect()] == [("b", 0), ("a", 1)]
    results = spark.createDataFrame([("M9", 0.1), ("M10", 0.01)], "marker string, pvalue double")
    assert [r["marker"] for r in plotdata.manhattan(results, marker_index(calls)).orderBy("position").collect()] == ["M10", "M9"]


def test_jobs_take_calls_with_places(spark, calls, phenotypes, covariates, tmp_path):
    placed = calls.withColumn("row_idx", 9 - F.substring("individual", 2, 1).cast("long")).withColumn("marker_idx", 9 - F.substring("marker", 2, 1).cast("long"))
    jobs.run_qc(placed, str(tmp_path / "qc"))
    lines = [r[0] for r in spark.read.text(str(tmp_path / "qc/matrix")).collect()]
    assert "id,M4,M3,M1" in lines and "I3,1.0,0.0,2.0" in lines
    assert jobs.run_gwas(placed, phenotypes, str(tmp_path / "gwas"), covariates).count() == 3
    points = spark.read.csv(str(tmp_path / "gwas/manhattan"), header=True).orderBy("position").collect()
    assert [r["marker"] for r in points] == ["M4", "M3", "M1"]
    assert jobs.run_pca(spark, placed, str(tmp_path / "pca"), 2).count() == 5
    assert jobs.run_gblup(placed, phenotypes, str(tmp_path / "gblup"), n_splits=3).count() == 5
    assert jobs.run_dendrogram(placed, str(tmp_path / "tree")).count() == 4
    assert jobs.run_admixture(placed, str(tmp_path / "admixture"), 2, max_iter=2).count() == 5


def test_repeated_cells_are_an_error(spark):
    df = spark.createDataFrame([("a", "m", 1.0), ("a", "m", 2.0)], "individual string, marker string, dosage double")
    with pytest.raises(PySparkException, match="repeated cell"):
        files.check_calls(df).collect()


def test_entry_and_registry(spark):
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert __spark_entry__.entry(spark).count() == 200
