"""Reading the tables the registered queries run over."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scalar_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "scalar_scylla_cdc_log")


def multi_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "multi_ck_scylla_cdc_log")
