"""SparkSession factory."""

from __future__ import annotations

from pyspark.sql import SparkSession


def build_session(master: str | None = None, cores: int = 8, **conf: str) -> SparkSession:
    """A session with adaptive execution and UTC timestamps.

    ``master`` is left to spark-submit where it is None. ``conf`` keys use two underscores for a dot
    (``spark__driver__memory="8g"``).
    """
    b = (
        SparkSession.builder.appName("brindle")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.showConsoleProgress", "false")
    )
    if master:
        b = b.master(master).config("spark.sql.shuffle.partitions", str(cores)).config("spark.driver.memory", "8g")
    for k, v in conf.items():
        b = b.config(k.replace("__", "."), v)
    return b.getOrCreate()
