"""Parquet table scans."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """Scan ``folder/name.parquet``."""
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")
