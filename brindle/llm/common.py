"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import ctypes
import gc

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.scratch import shared_path, shared_root, stored

__all__ = ["NOT_SPACE", "SPACE", "cut", "give_back", "let", "shared_path", "shared_root", "small_batches", "stored", "table", "words"]

#: The six ASCII white-space characters, as a class for Java's and DuckDB's regular expressions.
SPACE = r"[\x20\x09-\x0D]"
NOT_SPACE = r"[^\x20\x09-\x0D]"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cut(df: DataFrame) -> DataFrame:
    """``df`` with its lineage cut by a reliable checkpoint in the shared folder."""
    shared_root(df.sparkSession)
    return df.checkpoint(eager=True)


def words(text: Column) -> Column:
    """Array of the words ``[^\\x20\\x09-\\x0D]+`` of a text; null: empty array."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE + "+"), "")


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, also where lambdas in ``body`` use it."""
    return F.transform(F.array(value), body).getItem(0)


def small_batches(spark: SparkSession) -> None:
    """Lets Arrow batches hold 512 rows or 8 MB where the session has the defaults: a row here is a whole text."""
    for key, default, value in (("maxRecordsPerBatch", "10000", "512"), ("maxBytesPerBatch", None, str(8 << 20))):
        key = f"spark.sql.execution.arrow.{key}"
        if default is None or spark.conf.get(key) == default:
            spark.conf.set(key, value)


def give_back() -> None:
    """Returns a Python worker's free memory to the system: workers stay for tasks that may need less."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)
