"""Reading the input tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table `name` below sf_dir. Column pruning and filters reach the scan."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
