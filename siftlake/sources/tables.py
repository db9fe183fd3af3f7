"""Parquet warehouse: one directory or file for each table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The table's rows; column pruning and filters reach the Parquet scan."""
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")
