import os
import sys
import tempfile

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

GENOTYPES = {"I1": [0, 1, 2, 0], "I2": [1, 1, 1, 0], "I3": [2, None, 0, 1], "I4": [0, 2, 1, 2], "I5": [1, 0, 1, 1]}
YIELD = {"I1": 10.5, "I2": 12.1, "I3": 13.0, "I4": 11.2, "I5": 12.8}
COVARIATES = {"I1": (0.0, 1.0), "I2": (1.0, 1.0), "I3": (0.0, 2.0), "I4": (1.0, 2.0), "I5": (0.0, 1.0)}


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[4]").appName("tests")
        .config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.driver.memory", "4g")
        .config("spark.sql.session.timeZone", "UTC").config("spark.local.dir", tempfile.mkdtemp(prefix="spark-tests-"))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    session.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-shared-"))
    yield session
    session.stop()


@pytest.fixture(scope="session")
def calls(spark):
    rows = [(i, f"M{j + 1}", None if v is None else float(v)) for i, g in GENOTYPES.items() for j, v in enumerate(g)]
    return spark.createDataFrame(rows, "individual string, marker string, dosage double")


@pytest.fixture(scope="session")
def phenotypes(spark):
    return spark.createDataFrame([(i, v, n) for n, (i, v) in enumerate(YIELD.items())], "individual string, value double, row_idx long")


@pytest.fixture(scope="session")
def covariates(spark):
    return spark.createDataFrame([(i, *v) for i, v in COVARIATES.items()], "individual string, sex double, batch double")
