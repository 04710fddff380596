"""Reading the input tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table `name`, which lies as Parquet under `sf_dir` (any store that Spark can read)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
