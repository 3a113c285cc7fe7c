"""Connected components of a distributed edge table."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.llm.common import cut, stored


class Forest(dict):
    """Union-find over a partition's nodes; roots are the smallest members."""

    def root(self, a: int) -> int:
        top = a
        while (up := self.get(top, top)) != top:
            top = up
        while (up := self.get(a, a)) != top:
            self[a] = top
            a = up
        return top

    def join(self, a: int, b: int) -> None:
        a, b = self.root(a), self.root(b)
        self.setdefault(a, a)
        self.setdefault(b, b)
        self[max(a, b)] = min(a, b)


#: Nodes that a task holds before it emits its stars and starts afresh.
HELD = 500_000


def _stars(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    forest = Forest()

    def out() -> pd.DataFrame:
        pairs = [(a, r) for a in list(forest) if (r := forest.root(a)) != a]
        return pd.DataFrame(pairs, columns=["u", "v"], dtype="int64")

    for pdf in batches:
        for a, b in zip(pdf["u"].tolist(), pdf["v"].tolist(), strict=True):
            forest.join(a, b)
        if len(forest) > HELD:
            yield out()
            forest = Forest()
    yield out()


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node`` and ``root``, the smallest node reachable, for each node with a link to another node.

    Both ends are longs; rows with a null end and loops are ignored; no links give no rows. Each task first reduces
    its edges to stars. Then large-star and small-star steps alternate until nothing changes, each round cut off by a
    checkpoint in the shared folder. No round gathers a node's neighbours in one row or task: minima are combined on
    the map side and stored, so that the join with them is no longer bound to the aggregate's partitioning and
    adaptive execution can split a busy node.
    """
    u, v = F.col(a).cast("long"), F.col(b).cast("long")
    start = edges.where(u.isNotNull() & v.isNotNull() & (u != v)).select(F.greatest(u, v).alias("u"), F.least(u, v).alias("v"))
    e = cut(start.mapInPandas(_stars, "u long, v long").distinct())
    count = lambda df: tuple(df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
    state, before = count(e), None
    while state[0] and state != before:
        both = e.union(e.select("v", "u"))
        least = stored(both.groupBy("u").agg(F.least("u", F.min("v")).alias("m")), "least")
        large = cut(with_least(both.where(F.col("v") > F.col("u")), least).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        lower = stored(large.groupBy("u").agg(F.min("v").alias("m")), "lower")
        small = with_least(large, lower).where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = cut(small.union(lower.select("u", F.col("m").alias("v"))).distinct())
        state, before = count(e), state
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).union(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def with_least(edges: DataFrame, least: DataFrame) -> DataFrame:
    """``edges`` beside the ``m`` of their ``u``; ``least`` has one row a node and is a stored table."""
    return edges.join(least, "u")
