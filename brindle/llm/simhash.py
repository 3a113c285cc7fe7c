"""SimHash near-duplicates by a segment-popcount embedding.

A fingerprint of 64 bits is cut into 32 segments of two bits; its point is the vector of their bit counts. The
Manhattan distance of two points never exceeds the Hamming distance of the fingerprints. Written in unary, a
count of 0, 1 or 2 is 00, 01 or 11, so the whole point is one long and the Manhattan distance is the bit count of
an exclusive or.

Grid range-join: the 32 axes are dealt into k subspaces. Where the Manhattan distance is at most 3, at least k - 3
subspaces hold equal coordinates, so the two points share a unit cell of k - 3 subspaces. Points meet by an equi-join
on those cells, once for each pair (in one cell of those they share), and are verified exactly. More subspaces make
more cells for each point and finer ones: k grows with the number of fingerprints, so that random fingerprints
make about as many candidate pairs as cells at any size (``subspaces``). A cell with more than ``most_in_cell``
points is compared in blocks of pairs of chunks, and each block returns a spanning forest of its links rather than
the links.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brindle.llm.common import give_back, small_batches, stored
from brindle.llm.components import Forest, components

LOW = 0x5555555555555555
DISTANCE = 3
AXES = 32
MOST_IN_CELL = 1000
CHUNK = 1 << 16


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def candidates(n: int, k: int) -> float:
    """Pairs of ``n`` random fingerprints that are expected to meet in cells of ``k`` subspaces. Two random segments have
    equal bit counts with probability 3 / 8."""
    return n * n / 2 * sum(0.375 ** sum(map(len, cell)) for cell in combinations(_axes(k), k - DISTANCE))


def subspaces(n: int) -> int:
    """The least number of subspaces, from 6 to 12, with no more candidates than cells of ``n`` fingerprints."""
    return next((k for k in range(6, 12) if candidates(n, k) <= n * comb(k, DISTANCE)), 12)


def _axes(k: int) -> list[range]:
    return [range(AXES * i // k, AXES * (i + 1) // k) for i in range(k)]


def _masks(k: int) -> list[int]:
    """The bits of a point that each subspace has."""
    return [sum(3 << (2 * axis) for axis in axes) for axes in _axes(k)]


def fingerprint(text: str | None, shingle: int = 3, seed: int = 42) -> int:
    """The fingerprint as an unsigned int: bit k is 1 if set in over half the shingles' XXH64.

    ASCII letters are lower-cased and words are runs of anything but the six ASCII spaces, which is how
    ``bytes`` lower-cases and splits. Fewer words than ``shingle`` make one shingle; none give 0.
    """
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return 0
    n = max(1, len(words) - shingle + 1)
    shingles = zip(*(words[i:] for i in range(shingle)), strict=False) if len(words) >= shingle else [words]
    ones, hashed = np.zeros(64, np.int64), xxhash.xxh64_intdigest
    values = (hashed(b" ".join(s), seed) for s in shingles)
    for at in range(0, n, CHUNK):
        h = np.fromiter(values, ">u8", min(CHUNK, n - at))
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def fingerprinted(docs: DataFrame, text: str = "text", out: str = "fp") -> DataFrame:
    """``docs`` with the fingerprint as a signed long; a column of that name is replaced."""
    small_batches(docs.sparkSession)

    @F.pandas_udf("long")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(np.array([fingerprint(t) for t in texts], np.uint64).view(np.int64))
        give_back()

    return docs.withColumn(out, of(F.col(text)))


def point(fp: Column) -> Column:
    """The segments' bit counts in unary."""
    other = F.shiftrightunsigned(fp, 1)
    low = F.lit(LOW)
    return fp.bitwiseOR(other).bitwiseAND(low).bitwiseOR(F.shiftleft(fp.bitwiseAND(other).bitwiseAND(low), 1))


def _meeting(x: Column, y: Column, k: int) -> Column:
    """The one set of k - 3 subspaces, as bits, in which two points within reach are compared: the last that agree."""
    differ = x.bitwiseXOR(y)
    agree = sum((F.when(differ.bitwiseAND(F.lit(_signed(m))) == 0, 1 << i).otherwise(0) for i, m in enumerate(_masks(k))), F.lit(0))
    # Once for each subspace that a pair within reach may differ in, without writing the expression again each time.
    drop = lambda m, _: F.when(F.bit_count(m) > k - DISTANCE, m.bitwiseAND(m - 1)).otherwise(m)
    return F.aggregate(F.array(*[F.lit(0)] * DISTANCE), agree, drop)


def _forests(pdf: pd.DataFrame) -> pd.DataFrame:
    """A spanning forest of the links among a block's fingerprints."""
    fps = np.unique(pdf["fp"].to_numpy(np.int64))
    forest = Forest()
    bits = fps.view(np.uint64)
    for at in range(0, len(fps), 256):
        i, j = np.nonzero(np.bitwise_count(bits[at : at + 256, None] ^ bits[None, :]) <= DISTANCE)
        for a, b in zip(fps[i + at].tolist(), fps[j].tolist(), strict=True):
            if a < b:
                forest.join(a, b)
    return pd.DataFrame([(a, forest.root(a)) for a in list(forest) if forest.root(a) != a], columns=["a", "b"], dtype="int64")


def links(fps: DataFrame, most_in_cell: int = MOST_IN_CELL, k: int | None = None) -> DataFrame:
    """Links (a, b) between the distinct longs ``fp`` that connect exactly what distances of 3 or fewer connect.

    Every pair in a cell of at most ``most_in_cell`` points is a row of its own if it is close enough; larger
    cells give a spanning forest for each block. ``k`` subspaces (by default those for the number of rows) change
    the work and not the links. No rows give no links.
    """
    k = k or subspaces(fps.count())
    p, masks = point(F.col("fp")), _masks(k)
    sets = list(combinations(range(k), k - DISTANCE))
    cells = F.array(*(F.struct(F.lit(sum(1 << s for s in t)).alias("t"), p.bitwiseAND(F.lit(_signed(sum(masks[s] for s in t)))).alias("c")) for t in sets))
    placed = fps.select("fp", F.explode(cells).alias("x")).select("fp", F.col("x.t").cast("short").alias("t"), F.xxhash64("x.t", "x.c").alias("cell"))
    busy = stored(placed.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "cells")
    # One plan at every size: few busy cells would be broadcast, many not.
    shared = stored(placed.join(busy.hint("merge"), "cell"), "in-cells")
    few = shared.where(F.col("n") <= most_in_cell).select("cell", "t", "fp")
    x, y = few.alias("x"), few.alias("y")
    differ = F.col("x.fp").bitwiseXOR(F.col("y.fp"))
    px, py = point(F.col("x.fp")), point(F.col("y.fp"))
    near = (
        (F.col("x.cell") == F.col("y.cell"))
        & (F.col("x.fp") < F.col("y.fp"))
        & (F.bit_count(px.bitwiseXOR(py)) <= DISTANCE)
        & (F.bit_count(differ) <= DISTANCE)
        & (_meeting(px, py, k) == F.col("x.t"))
    )
    pairs = x.join(y, near).select(F.col("x.fp").alias("a"), F.col("y.fp").alias("b"))

    many = shared.where(F.col("n") > most_in_cell)
    side = F.ceil(F.col("n") / most_in_cell).cast("int")
    mine = F.pmod(F.xxhash64("fp"), F.col("side")).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("side") - 1))
    blocks = many.withColumn("side", side).withColumn("mine", mine).withColumn("other", other)
    blocks = blocks.select("cell", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), "fp")
    return pairs.union(blocks.groupBy("cell", "i", "j").applyInPandas(_forests, "a long, b long"))


def grouped(docs: DataFrame, key: str = "doc_id", text: str = "text", most_in_cell: int = MOST_IN_CELL) -> DataFrame:
    """One row per row of ``docs``: ``doc_id``, ``fp`` (long) and ``component_id``.

    component_id is the smallest non-null key reachable by links; rows with a null key take part, and it is null
    where a component has no other rows. Copies share a fingerprint and meet only as one row of the table of
    fingerprints. Texts without a word (null, empty) have fingerprint 0 and link like any other.
    """
    marked = stored(fingerprinted(docs.select(F.col(key).alias("doc_id"), F.col(text).alias("_text")), "_text").select("doc_id", "fp"), "fingerprints")
    fps = stored(marked.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    of = _rooted(fps, most_in_cell)
    least = of.where("linked").groupBy("root").agg(F.min("least").alias("smallest"))
    named = of.join(least, "root", "left").select("fp", F.coalesce("smallest", "least").alias("component_id"))
    return marked.join(named, "fp").select("doc_id", "fp", "component_id")


def _rooted(fps: DataFrame, most_in_cell: int) -> DataFrame:
    """``fps`` (distinct ``fp``) with the ``root`` of each component and whether it is ``linked`` to another."""
    roots = components(links(fps.select("fp"), most_in_cell)).select(F.col("node").alias("fp"), "root")
    return fps.join(roots, "fp", "left").withColumn("linked", F.col("root").isNotNull()).withColumn("root", F.coalesce("root", "fp"))


def representatives(docs: DataFrame, key: str = "doc_id", text: str = "text", most_in_cell: int = MOST_IN_CELL) -> DataFrame:
    """The rows of ``docs`` that stay, in its columns: of each component, one with the smallest key.

    Null keys come last. Of rows that tie, also repeated ones and those with null keys, one stays. Texts without a word
    (null, empty) are one group. No rows give no rows.
    """
    rows = stored(fingerprinted(docs, text, "_fp").withColumn("_row", F.monotonically_increasing_id()), "to-dedup")
    order = F.struct(F.col(key).isNull(), F.col(key), F.col("_row"))
    fps = stored(rows.groupBy(F.col("_fp").alias("fp")).agg(F.min(order).alias("least")), "distinct")
    best = _rooted(fps, most_in_cell).groupBy("root").agg(F.min("least").alias("least"))
    return rows.join(best.select(F.col("least._row").alias("_row")), "_row", "left_semi").select(*docs.columns)


def hexed(fp: Column) -> Column:
    """16 lower-case hex digits."""
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
