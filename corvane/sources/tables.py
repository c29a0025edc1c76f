"""Parquet table sources."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table `name` of the data set at `sf_dir`, on any store that Spark reads."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
