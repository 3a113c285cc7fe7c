"""Exact near-duplicate embeddings by cover trees and dual traversal.

Vectors of a label with a cosine of at least the threshold are linked: for unit vectors, those within a distance
of sqrt(2 - 2 * threshold). A cover tree nests nets of halving radii: a node's children are centres of half its
radius that cover its points, the node's own centre among them. Two nodes can hold a link only if the distance of
their centres is at most the sum of their covering radii (the true ones, measured on their points) and the
threshold distance. A dual traversal starts from two roots and replaces a surviving pair of nodes by the pairs of
their children; pairs of points that are left are verified by their cosine in double precision.

A label with more than ``block_rows`` distinct vectors is dealt into blocks around centres taken from its own rows
(a bounded number, from a hash order; which they are affects speed alone), and a block that is still too large is
dealt again around centres of its own. Pairs of blocks are pruned by the same bound, and so is each vector of a
block against the other block's centre; each surviving pair is one task's work, which returns every vector's number
of links there and one row for each vector of a spanning forest, never the pairs.

The nodes of all this are distinct vectors of a label, numbered when their table is written. Ids come back at the end.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.llm.common import let, small_batches, stored
from brindle.llm.components import Forest, components

#: Slack for rounding in pruning; links themselves are decided by the cosine alone.
SLACK = 1e-9
LEAF = 16
#: Candidate pairs that are verified at a time.
TOGETHER = 1 << 16


class CoverTree:
    """Nested nets over the rows of ``x``. Node k has a centre (a row), a covering radius, and children or rows."""

    def __init__(self, x: np.ndarray, smallest: float):
        self.x = x
        self.centre: list[int] = []
        self.radius: list[float] = []
        self.children: list[np.ndarray | None] = []
        self.rows: list[np.ndarray] = []
        rows = np.arange(len(x))
        dist = self._dist(0, rows)
        todo = [(self._node(0, rows, dist), float(dist.max(initial=0.0)) / 2)]
        while todo:
            k, r = todo.pop()
            if len(self.rows[k]) <= LEAF or self.radius[k] <= smallest:
                continue
            kids = self._cover(self.centre[k], self.rows[k], r)
            if len(kids) == 1:
                todo.append((k, r / 2)) if r > smallest else None
                continue
            self.children[k] = np.array([self._node(c, m, d) for c, m, d in kids])
            todo += [(int(c), r / 2) for c in self.children[k]]

    def _dist(self, c: int, rows: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(0.0, ((self.x[rows] - self.x[c]) ** 2).sum(axis=1)))

    def _node(self, c: int, rows: np.ndarray, dist: np.ndarray) -> int:
        self.centre.append(c)
        self.radius.append(float(dist.max(initial=0.0)))
        self.children.append(None)
        self.rows.append(rows)
        return len(self.centre) - 1

    def _cover(self, c: int, rows: np.ndarray, r: float) -> list[tuple[int, np.ndarray, np.ndarray]]:
        """Centres about ``r`` apart, ``c`` first, the rows that each covers, and their true distances. Distances that
        only decide on centres come from products of matrices, for some next centres at a time."""
        x, out, step = self.x[rows], [], 1
        square, free = (x * x).sum(axis=1), np.ones(len(rows), bool)
        turn = np.flatnonzero(rows == c)
        while len(turn):
            apart = square[turn][:, None] + square[None, :] - 2 * x[turn] @ x.T
            for k, own in enumerate(turn):
                if free[own]:
                    near = free & (apart[k] <= r * r)
                    near[own] = True
                    free &= ~near
                    mine = rows[near]
                    out.append((int(rows[own]), mine, self._dist(int(rows[own]), mine)))
            turn, step = np.flatnonzero(free)[:step], min(64, 2 * step)
        return out


def pairs(a: CoverTree, b: CoverTree, reach: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows (of a, of b) that may lie within ``reach``; where both are one tree, each pair once and no row itself."""
    same = a is b
    todo = [(0, 0)] if len(a.x) and len(b.x) else []
    ca, ra, cb, rb = np.array(a.centre), np.array(a.radius), np.array(b.centre), np.array(b.radius)

    def kids(t: CoverTree, k: int) -> np.ndarray:
        return np.array([k]) if t.children[k] is None else t.children[k]

    while todo:
        i, j = todo.pop()
        if a.children[i] is None and b.children[j] is None:
            p, q = np.repeat(a.rows[i], len(b.rows[j])), np.tile(b.rows[j], len(a.rows[i]))
            if same and i == j:
                p, q = p[p < q], q[p < q]
            yield p, q
            continue
        u, v = kids(a, i), kids(b, j)
        for at in range(0, len(u), 1024):
            w = u[at : at + 1024]
            xa, xb = a.x[ca[w]], b.x[cb[v]]
            d2 = (xa * xa).sum(1)[:, None] + (xb * xb).sum(1)[None, :] - 2 * xa @ xb.T
            most = ra[w][:, None] + rb[v][None, :] + reach + 1e-6
            s, t = np.nonzero(d2 <= most * most)
            for m, n in zip(w[s].tolist(), v[t].tolist(), strict=True):
                if not same or m <= n or i != j:
                    todo.append((m, n))


def linked(x: np.ndarray, y: np.ndarray, threshold: float, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows of ``x`` and ``y`` with a cosine of at least ``threshold`` in double precision."""
    nx, ny = np.sqrt((x * x).sum(axis=1)), np.sqrt((y * y).sum(axis=1))
    reach = float(np.sqrt(max(0.0, 2 - 2 * threshold))) + SLACK
    a = CoverTree(x / nx[:, None], reach / 4)
    b = a if same else CoverTree(y / ny[:, None], reach / 4)
    held: list[tuple[np.ndarray, np.ndarray]] = []

    def near() -> tuple[np.ndarray, np.ndarray]:
        s, t = (np.concatenate(z) for z in zip(*held, strict=True))
        held.clear()
        ok = (x[s] * y[t]).sum(axis=1) / (nx[s] * ny[t]) >= threshold
        return s[ok], t[ok]

    waiting = 0
    for p, q in pairs(a, b, reach):
        for at in range(0, len(p), TOGETHER):
            held.append((p[at : at + TOGETHER], q[at : at + TOGETHER]))
            waiting += len(held[-1][0])
            if waiting >= TOGETHER:
                yield near()
                waiting = 0
    if waiting:
        yield near()


class Groups:
    """Nodes 0 .. n - 1 and the sets that links join them to; ``least`` is the smallest member's place."""

    def __init__(self, n: int):
        self.top, self.forest = np.arange(n), Forest()

    def join(self, s: np.ndarray, t: np.ndarray) -> None:
        """Each pass joins one link of every set that still has one to another, so the Python loop is over sets, whose
        number at least halves, and not over links."""
        while True:
            a, b = self.top[s], self.top[t]
            across = a != b
            if not across.any():
                return
            s, t, a, b = s[across], t[across], a[across], b[across]
            _, first = np.unique(a, return_index=True)
            for x, y in zip(a[first].tolist(), b[first].tolist(), strict=True):
                self.forest.join(x, y)
            tops, at = np.unique(self.top, return_inverse=True)
            self.top = np.array([self.forest.root(x) for x in tops.tolist()])[at]


def _compare(threshold: float):
    def of(pdf: pd.DataFrame) -> pd.DataFrame:
        """Links between the sides of a pair of blocks: how many rows each vector is linked to, and a forest."""
        left, right = pdf[pdf["side"] == 0], pdf[pdf["side"] == 1]
        same = int(pdf["i"].iat[0]) == int(pdf["j"].iat[0])
        right = left if same else right
        names = left["node"].to_numpy(np.int64) if same else np.concatenate([left["node"], right["node"]]).astype(np.int64)
        copies = left["copies"].to_numpy(np.int64) if same else np.concatenate([left["copies"], right["copies"]]).astype(np.int64)
        shift = 0 if same else len(left)
        found, groups = np.zeros(len(names), np.int64), Groups(len(names))
        if len(left) and len(right):
            x = np.vstack(left["v"].to_numpy()).astype(np.float64)
            y = x if same else np.vstack(right["v"].to_numpy()).astype(np.float64)
            for s, t in linked(x, y, threshold, same):
                t = t + shift
                found += np.bincount(s, copies[t], len(names)).astype(np.int64) + np.bincount(t, copies[s], len(names)).astype(np.int64)
                groups.join(s, t)
        on = np.flatnonzero(found)
        return pd.DataFrame({"node": names[on], "links": found[on], "root": names[groups.top[on]]})

    return of


def _valid(vec: Column) -> Column:
    """Whether a vector can link: not null, no null or non-finite component, not zero, one component at least."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return F.coalesce((F.size(vec) > 0) & F.forall(vec, finite) & F.exists(vec, lambda x: x != 0), F.lit(False))


def grouped(
    vectors: DataFrame,
    key: str = "vec_id",
    vector: str = "embedding",
    label: str = "label",
    threshold: float = 0.98,
    block_rows: int = 2000,
    most_centres: int = 2000,
) -> DataFrame:
    """One row per row of ``vectors``: vec_id, n_links, component_id, kept.

    Rows with a null label or an invalid vector (null, empty, zero, null or non-finite components) link with
    nothing and are their own component. Vectors of different lengths never link. Equal vectors of a label are
    compared once, as one vector with a number of copies; rows that share a key, also across labels, count as rows
    of their own. Rows with a null key link like others; component_id is the smallest key that is known, null where
    none is, and ``kept`` is whether it is the row's own (null and null count as equal). No rows give no rows.
    """
    small_batches(vectors.sparkSession)
    v = vectors.select(F.col(key).cast("long").alias("vec_id"), F.col(label).alias("label"), F.transform(F.col(vector), lambda x: x.cast("double")).alias("v"))
    ok = _valid(F.col("v")) & F.col("label").isNotNull()
    good = v.where(ok).withColumn("h", F.xxhash64("label", "v"))
    distinct = good.groupBy("label", "v").agg(F.min("vec_id").alias("least"), F.count(F.lit(1)).alias("copies"), F.first("h").alias("h"))
    distinct = stored(distinct.withColumn("node", F.monotonically_increasing_id()), "vectors")
    sizes = distinct.groupBy(F.col("label").alias("_label"), F.size("v").alias("_width")).agg(F.count(F.lit(1)).alias("n"))
    groups = stored(sizes.withColumn("group", F.monotonically_increasing_id()), "groups")
    rows = distinct.join(groups, (F.col("label") == F.col("_label")) & (F.size("v") == F.col("_width"))).select("group", "node", "copies", "v", "h")

    sides = _pairs_of_blocks(_blocks(rows, block_rows, most_centres), threshold)
    found = stored(sides.groupBy("group", "i", "j").applyInPandas(_compare(threshold), "node long, links long, root long"), "links")

    links = found.groupBy(F.col("node").alias("_n")).agg(F.sum("links").alias("links"))
    roots = stored(components(found.select("node", "root"), "node", "root").withColumnRenamed("node", "_n"), "roots")
    of = stored(distinct.select("node", "least").join(roots, F.col("node") == F.col("_n"), "left").select("node", "least", F.coalesce("root", "node").alias("root")), "rooted")
    least = of.groupBy(F.col("root").alias("_root")).agg(F.min("least").alias("component_id"))
    named = (
        distinct.select("h", F.col("label").alias("_label"), F.col("v").alias("_v"), "node", "copies")
        .join(links, F.col("node") == F.col("_n"), "left")
        .drop("_n")
        .join(of.select(F.col("node").alias("_n"), "root"), F.col("node") == F.col("_n"))
        .join(least, F.col("root") == F.col("_root"))
        .select("h", "_label", "_v", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id")
    )
    linked_rows = good.join(stored(named, "named"), "h").where((F.col("label") == F.col("_label")) & (F.col("v") == F.col("_v"))).select("vec_id", "n_links", "component_id")
    alone = v.where(~ok).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    both = linked_rows.union(alone)
    return both.select("vec_id", "n_links", "component_id", F.col("vec_id").eqNullSafe(F.col("component_id")).alias("kept"))


#: How often blocks that are too large are dealt around centres of their own, and the room for them in a block's number.
LEVELS, ROOM = 3, 1 << 12


def _blocks(rows: DataFrame, block_rows: int, most_centres: int) -> DataFrame:
    """``rows`` (group, node, copies, v, h) with a ``block``: 0 in small groups. A block of more than ``block_rows`` is
    dealt to the nearest of centres of its own, LEVELS times at most, and then by a hash. Centres are at most twice
    ``most_centres`` a level, shared by size, so their table is small whatever the input."""
    most_centres = min(most_centres, ROOM // 2 - 1)
    rows = rows.withColumn("block", F.lit(0).cast("long"))
    for level in range(LEVELS + 1):
        large = stored(rows.groupBy("group", "block").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > block_rows), "large")
        total = large.agg(F.sum("n")).first()[0]
        if not total:
            return rows.select("group", "node", "copies", "v", "block")
        mine = rows.join(large, ["group", "block"], "left")
        if level == LEVELS:
            part = F.when(F.col("n").isNotNull(), F.pmod(F.xxhash64("h"), F.ceil(F.col("n") / block_rows)) + 1).otherwise(0)
            return mine.select("group", "node", "copies", "v", (F.col("block") * F.lit(1 << 24) + part).alias("block"))
        wanted = F.least(F.ceil(F.col("n") / block_rows), F.greatest(F.lit(1), F.floor(F.col("n") * most_centres / total)))
        chance = (F.pmod(F.xxhash64("h", F.lit(level)), F.lit(1 << 30)) / float(1 << 30)) < wanted / F.col("n")
        centres = mine.where(chance).orderBy("h", "node").limit(2 * most_centres).groupBy("group", "block").agg(F.sort_array(F.collect_list("v")).alias("c"))
        table = {(r["group"], r["block"]): np.array(r["c"], np.float64) for r in centres.toLocalIterator()}
        nearest = _nearest({k: c / np.linalg.norm(c, axis=1)[:, None] for k, c in table.items()}, rows.sparkSession)
        dealt = F.when(F.col("n").isNotNull(), nearest("group", "block", "v") + 1).otherwise(0)
        rows = stored(mine.select("group", "node", "copies", "v", "h", (F.col("block") * F.lit(ROOM) + dealt).alias("block")), "dealt")


def _nearest(table: dict[tuple[int, int], np.ndarray], spark: SparkSession):
    """Place of the nearest of a block's centres; 0 where it has none."""
    shared = spark.sparkContext.broadcast(table)

    @F.pandas_udf("long")
    def nearest(group: pd.Series, block: pd.Series, v: pd.Series) -> pd.Series:
        out, of = np.zeros(len(v), np.int64), shared.value
        for key, at in pd.DataFrame({"g": group, "b": block}).groupby(["g", "b"]).indices.items():
            if (c := of.get(key)) is not None:
                x = np.vstack(v.to_numpy()[at])
                out[at] = (x @ c.T).argmax(axis=1)
        return pd.Series(out)

    return nearest


def _apart(u: pd.Series, v: pd.Series) -> pd.Series:
    """Distances of vectors, none of which is empty."""
    if not len(u):
        return pd.Series([], dtype="float64")
    ends = np.cumsum([len(x) for x in u])
    d = np.concatenate(u.to_numpy()) - np.concatenate(v.to_numpy())
    return pd.Series(np.sqrt(np.add.reduceat(d * d, np.concatenate([[0], ends[:-1]]))))


def _pairs_of_blocks(placed: DataFrame, threshold: float) -> DataFrame:
    """Rows for each pair (i <= j) of blocks of a group that may hold links, with the ``side`` they are on.

    A block's centre is its first vector by node and its radius the greatest distance from it, so the bound is exact.
    A vector goes to the pair only if it is within the other block's radius of its centre, and the reach.
    """
    norm = lambda c: F.sqrt(F.aggregate(c, F.lit(0.0), lambda s, y: s + y * y))
    unit = lambda c: let(norm(c), lambda n: F.transform(c, lambda x: x / n))
    apart = F.pandas_udf(_apart, "double")
    placed = stored(placed.withColumn("u", unit(F.col("v"))), "blocks")
    first = stored(placed.groupBy("group", "block").agg(F.min_by("u", "node").alias("centre")), "centres")
    reach = float(np.sqrt(max(0.0, 2 - 2 * threshold))) + 1e-6
    away = placed.join(first, ["group", "block"]).withColumn("d", apart(F.col("u"), F.col("centre")))
    radii = away.groupBy("group", "block").agg(F.max("d").alias("radius"))
    blocks = stored(first.join(radii, ["group", "block"]), "radii")
    x, y = blocks.alias("x"), blocks.alias("y")
    near = (F.col("x.group") == F.col("y.group")) & (F.col("x.block") <= F.col("y.block"))
    close = apart(F.col("x.centre"), F.col("y.centre")) <= F.col("x.radius") + F.col("y.radius") + reach
    of = lambda block, other, side: (
        F.col("x.group").alias("group"), F.col(f"{block}.block").alias("block"), F.col("x.block").alias("i"), F.col("y.block").alias("j"),
        F.lit(side).alias("side"), F.col(f"{other}.centre").alias("centre"), (F.col(f"{other}.radius") + reach).alias("most"),
    )
    pairs_ = stored(x.join(y, near).where(close).select(F.struct(*of("x", "y", 0)).alias("a"), F.struct(*of("y", "x", 1)).alias("b")), "pairs")
    sides = pairs_.select("a.*").union(pairs_.where("a.i < a.j").select("b.*"))
    reaching = apart(F.col("u"), F.col("centre")) <= F.col("most")
    return placed.join(sides, ["group", "block"]).where(reaching).select("group", "i", "j", "side", "node", "copies", "v")
