"""Genotypes, phenotypes and covariates derived from general tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def calls_l(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sparse calls from ``lineitem``: suppliers are individuals, 200 part groups are markers; absent cells are missing."""
    cell = (
        spark.read.parquet(f"{sf_dir}/lineitem.parquet")
        .groupBy(F.col("l_suppkey").alias("ind"), (F.col("l_partkey") % 200).alias("m"))
        .agg(F.sum(F.col("l_quantity").cast("bigint") * (F.col("l_linenumber") + F.col("l_orderkey") % 97)).alias("s"))
    )
    limit = "5 + (m * 13) % 90"
    first = f"case when (s * 7 + m) % 101 < {limit} then 1 else 0 end"
    second = f"case when ((s div 101) * 11 + m * 3) % 101 < {limit} then 1 else 0 end"
    return cell.select(
        F.concat(F.lit("I"), F.col("ind").cast("string")).alias("individual"),
        F.concat(F.lit("M"), F.col("m").cast("string")).alias("marker"),
        F.expr(f"cast({first} + {second} as double)").alias("dosage"),
    )


def pheno_l(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = spark.read.parquet(f"{sf_dir}/supplier.parquet")
    return table.select(F.concat(F.lit("I"), F.col("s_suppkey").cast("string")).alias("individual"), F.col("s_acctbal").cast("double").alias("value"))


def cov_l(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = spark.read.parquet(f"{sf_dir}/supplier.parquet")
    return table.select(
        F.concat(F.lit("I"), F.col("s_suppkey").cast("string")).alias("individual"),
        (F.col("s_nationkey") % 2).cast("double").alias("c1"), (F.col("s_nationkey") % 5).cast("double").alias("c2"),
    )


def calls_e(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dense calls from ``embeddings``: 64 markers, values near zero are missing."""
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    long = table.select("vec_id", F.posexplode("embedding").alias("i", "e")).withColumn("x", F.col("e").cast("double"))
    dosage = F.expr("cast(case when abs(x) < 0.004D then null when x < -0.05D then 0 when x < 0.06D then 1 else 2 end as double)")
    return long.select(
        F.concat(F.lit("V"), F.col("vec_id").cast("string")).alias("individual"),
        F.concat(F.lit("E"), F.col("i").cast("string")).alias("marker"), dosage.alias("dosage"),
    )


def pheno_e(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    value = F.expr("3.0D * cast(embedding[0] as double) - 2.0D * cast(embedding[5] as double) + 0.1D * label")
    return table.select(F.concat(F.lit("V"), F.col("vec_id").cast("string")).alias("individual"), value.alias("value"))
