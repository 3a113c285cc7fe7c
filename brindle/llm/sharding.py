"""Sharding by a permutation-filled lookup table (native).

Each shard has its own preference order over the slots of a table of prime size (an offset and a step, both from
a hash of its name). Shards take turns claiming the next free slot they prefer until none is left, so all hold
nearly equally many, and taking a shard away moves few slots of the others. A key's slot is a hash of the
key modulo the size; the table has a fixed number of rows, so it is broadcast and placement is one look-up.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence
from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SIZE = 65537


def _hash(text: str) -> int:
    """The first 60 bits of MD5."""
    return int(hashlib.md5(text.encode()).hexdigest()[:15], 16)


@lru_cache(maxsize=16)
def _filled(shards: tuple[str, ...], size: int) -> tuple[int, ...]:
    if not shards or len(set(shards)) < len(shards):
        raise ValueError("shards need distinct names, one at least")
    if size < len(shards) or any(size % d == 0 for d in range(2, int(size**0.5) + 1)):
        raise ValueError("the table's size must be a prime of at least the number of shards")
    at = [_hash(f"offset:{s}") % size for s in shards]
    step = [_hash(f"step:{s}") % (size - 1) + 1 for s in shards]
    table, free = [-1] * size, size
    while free:
        for k in range(len(shards)):
            while table[at[k]] >= 0:
                at[k] = (at[k] + step[k]) % size
            table[at[k]] = k
            free -= 1
            if not free:
                break
    return tuple(table)


def lookup_table(shards: Sequence[str], size: int = SIZE) -> tuple[int, ...]:
    """The place in ``shards`` that holds each slot."""
    return _filled(tuple(shards), size)


def slot(key: Column, size: int = SIZE) -> Column:
    """A key's slot; a null key has that of the empty text."""
    digits = F.substring(F.md5(F.coalesce(key.cast("string"), F.lit(""))), 1, 15)
    return (F.conv(digits, 16, 10).cast("long") % size).cast("int")


def place(df: DataFrame, key: str, shards: Sequence[str], size: int = SIZE, out: str = "shard") -> DataFrame:
    """``df`` with ``slot`` and the name of the shard that holds it; columns of these names are replaced.

    Rows are neither moved nor dropped, and equal keys, also hot ones, land in one shard; null keys are one key. An empty
    table stays empty.
    """
    names = F.array(*map(F.lit, shards))
    held = F.split(F.lit(",".join(map(str, lookup_table(shards, size)))), ",")
    table = df.sparkSession.range(1).select(F.posexplode(held).alias("slot", "_k")).select("slot", F.element_at(names, F.col("_k").cast("int") + 1).alias(out))
    rest = [c for c in df.columns if c not in ("slot", out)]
    return df.select(*rest, slot(F.col(key), size).alias("slot")).join(F.broadcast(table), "slot").select(*rest, "slot", out)


def lay_out(df: DataFrame, key: str, shards: Sequence[str], path: str, size: int = SIZE, out: str = "shard") -> None:
    """Writes whole rows as Parquet, each in the folder of its shard. A shard is a task's work, but a large one is split
    over several (by adaptive execution), so it may have several files."""
    place(df, key, shards, size, out).hint("rebalance", out).write.partitionBy(out).parquet(path)
