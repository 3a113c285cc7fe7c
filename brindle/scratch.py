"""Places for intermediate tables that driver and executors share."""

from __future__ import annotations

import re
import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_HERE = threading.local()
_RUNS: dict[tuple[str, str], str] = {}


def _hadoop(spark: SparkSession, path: str):
    """A path as Hadoop has it, and its file system."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return fs, fs.makeQualified(p)


def qualified(spark: SparkSession, path: str) -> str:
    """``path`` with its scheme; one without a scheme is in the cluster's default file system, as it is for Spark."""
    _, p = _hadoop(spark, path)
    return re.sub(r"^file:/+", "file:///", p.toString()).rstrip("/")


def shared_root(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which driver and executors share, with its scheme.

    Where none is set, a local master gets a temporary folder. On a cluster that is an error, since a folder of one
    machine's would lose what the others write.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="brindle-checkpoint-")
    root = qualified(spark, root)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(root)
    return root


def run_folder(spark: SparkSession) -> str:
    """This application's folder in the shared one; it is deleted when the application ends."""
    key = (spark.sparkContext.applicationId, shared_root(spark))
    if key not in _RUNS:
        path = f"{key[1]}/brindle-{uuid.uuid4().hex}"
        fs, p = _hadoop(spark, path)
        fs.mkdirs(p)
        fs.deleteOnExit(p)
        _RUNS[key] = path
    return _RUNS[key]


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the application's folder; what is there goes at the end of a block of ``passing``, or with the folder."""
    path = f"{run_folder(spark)}/{name}-{uuid.uuid4().hex}"
    if (held := getattr(_HERE, "paths", None)) is not None:
        held.append(path)
    return path


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a file or folder, if it is there."""
    fs, p = _hadoop(spark, path)
    fs.delete(p, True)


@contextmanager
def passing(spark: SparkSession) -> Iterator[None]:
    """What is stored in this block is deleted at its end: write results that are to last by a path of before."""
    before, _HERE.paths = getattr(_HERE, "paths", None), []
    try:
        yield
    finally:
        mine, _HERE.paths = _HERE.paths, before
        for path in mine:
            remove(spark, path)


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read back: for what is read more than once."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
