"""Ordering."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brindle.scratch import stored


def order_by(df: DataFrame, keys: Sequence[tuple[str, bool]]) -> DataFrame:
    """Sorted by (column, ascending); NULL is the largest value, so it comes last ascending and first descending."""
    return df.orderBy(*(F.col(k).asc_nulls_last() if asc else F.col(k).desc_nulls_first() for k, asc in keys))


def numbered(df: DataFrame, name: str, group: Sequence[str] = ()) -> DataFrame:
    """``df``, sorted (by ``group`` first), with each row's number from 1 in its group as the long ``name``.

    The rows are stored in their order; each run of a group in a partition is counted, and the numbers of a run start
    behind those of the group's earlier runs. No task gathers a group: the table of runs has a row for each
    partition and group that meet.
    """
    rows = stored(df.withColumn("_at", F.monotonically_increasing_id()), "ordered").withColumn("_part", F.shiftright("_at", 33))
    runs = rows.groupBy("_part", *group).agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    runs = stored(runs.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))), "runs")
    here = runs.select(*(F.col(c).alias(f"_r_{c}") for c in ("_part", *group)), "_first", "_before")
    on = F.lit(True)
    for c in ("_part", *group):
        on = on & F.col(c).eqNullSafe(F.col(f"_r_{c}"))
    return rows.join(here, on).select(*df.columns, (F.col("_before") + F.col("_at") - F.col("_first") + 1).alias(name))


def ranked(df: DataFrame, group: Sequence[str], order: Sequence[Column], name: str) -> DataFrame:
    """``df`` with each row's place from 1 in the order of its group, ranges of which are sorted by different tasks."""
    keys = [*map(F.col, group), *order]
    return numbered(df.repartitionByRange(*keys).sortWithinPartitions(*keys), name, group)
