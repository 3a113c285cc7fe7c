"""Columnar files. Parquet's dictionaries and row-group statistics stand in for dictionary columns and indexes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession


def write_columnar(df: DataFrame, path: str, sort_by: Sequence[str] = (), mode: str = "errorifexists") -> None:
    """Parquet; sorting within files narrows the row-group statistics of the columns that filters use."""
    (df.sortWithinPartitions(*sort_by) if sort_by else df).write.mode(mode).parquet(path)


def read_columnar(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
