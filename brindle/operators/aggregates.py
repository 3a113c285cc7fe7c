"""Keyless and grouped aggregation."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _named(columns: Mapping[str, Column | str]) -> list[Column]:
    return [(F.col(e) if isinstance(e, str) else e).alias(n) for n, e in columns.items()]


def aggregate(df: DataFrame, aggregates: Mapping[str, Column]) -> DataFrame:
    """Exactly one row, also for empty inputs."""
    return df.agg(*_named(aggregates))


def group_by_aggregate(df: DataFrame, keys: Mapping[str, Column | str], aggregates: Mapping[str, Column], having: Column | None = None) -> DataFrame:
    """One row per combination of key expressions, NULL being a key; no input rows give no rows.

    ``having`` filters the result by the names of keys and aggregates.
    """
    grouped = df.groupBy(*_named(keys))
    out = grouped.agg(*_named(aggregates)) if aggregates else df.select(*_named(keys)).distinct()
    return out if having is None else out.filter(having)
