"""Inner joins of two and of many tables, and products."""

from __future__ import annotations

import re
from collections.abc import Collection, Mapping, Sequence
from functools import reduce
from math import prod

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.tables import KEYS

#: Hints by strategy; None leaves the choice to Spark.
STRATEGIES = {None: None, "merge": "merge", "shuffle_hash": "shuffle_hash", "broadcast": "broadcast"}
#: A broadcast hint is only given to inputs that Spark estimates at no more than this.
BROADCAST_BYTES = 64 << 20
#: Quoted text in an expression.
QUOTED = re.compile(r"'(?:[^']|'')*'|\"[^\"]*\"")
#: alias.column = alias.column
EQUALITY = re.compile(r"\s*(\w+)\.(\w+)\s*=\s*(\w+)\.(\w+)\s*")


def estimated_bytes(df: DataFrame) -> int:
    """Spark's own estimate of a plan's output: file sizes scaled by what is pruned. Runs no job."""
    return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())


def _hinted(df: DataFrame, strategy: str | None) -> DataFrame:
    hint = STRATEGIES[strategy]
    if hint is None or (hint == "broadcast" and estimated_bytes(df) > BROADCAST_BYTES):
        return df
    return df.hint(hint)


def hash_join(left: DataFrame, right: DataFrame, keys: Sequence[tuple[str, str]], strategy: str | None = None) -> DataFrame:
    """Inner equi-join on pairs of columns (left, right); NULL keys join nothing. Both key columns are kept.

    The keys are copied under names of their own first, so a table can be joined with itself on any columns.
    """
    mine = left.withColumns({f"_left_{k}": F.col(a) for k, (a, _) in enumerate(keys)})
    other = right.withColumns({f"_right_{k}": F.col(b) for k, (_, b) in enumerate(keys)})
    copies = [(f"_left_{k}", f"_right_{k}") for k in range(len(keys))]
    on = reduce(lambda a, b: a & b, (F.col(a) == F.col(b) for a, b in copies))
    return mine.join(_hinted(other, strategy), on, "inner").drop(*(c for pair in copies for c in pair))


def cross_product(left: DataFrame, right: DataFrame) -> DataFrame:
    """All pairs of rows."""
    return left.crossJoin(right)


def scalar_cross(df: DataFrame, one_row: DataFrame) -> DataFrame:
    """Every row beside the single row of a keyless aggregate, which is small by construction and so is broadcast."""
    return df.crossJoin(F.broadcast(one_row))


def tables_of(predicate: str, names: Sequence[str]) -> frozenset[str]:
    """Tables that a predicate such as ``a.x = b.y`` refers to; quoted text does not count."""
    bare = QUOTED.sub("", predicate)
    return frozenset(t for t in re.findall(r"\b([A-Za-z_]\w*)\s*\.\s*[A-Za-z_`]", bare) if t in names)


def _growth(n: str, bound: set[str], predicates: Sequence[str], unique: Collection[str]) -> int:
    """How joining ``n`` to ``bound`` can multiply rows: 0, it looks up a unique column of ``n``; 1, ``n``'s rows look up
    a unique column of a bound table; 2, many to many or not by equality; 3, no predicate connects them."""
    out = 3
    for p in predicates:
        t = tables_of(p, [n, *bound])
        if n not in t or len(t) < 2:
            continue
        out = min(out, 2)
        if sides := EQUALITY.fullmatch(p):
            a, x, b, y = sides.groups()
            mine, other = ((a, x), (b, y)) if a == n else ((b, y), (a, x))
            single = lambda c: c[1] in unique or ".".join(c) in unique
            out = min(out, 0 if single(mine) else 1 if single(other) else 2)
    return out


def join_order(names: Sequence[str], predicates: Sequence[str], size: Mapping[str, int], prefix: Sequence[str] = (), unique: Collection[str] = ()) -> list[str]:
    """``prefix``, then always the table that multiplies rows least, the smallest of equals.

    Joins on unique columns thus come before many-to-many ones, and those before products.
    """
    order = list(prefix)
    rest = [n for n in names if n not in order]
    while rest:
        order.append(min(rest, key=lambda n: (_growth(n, set(order), predicates, unique), size[n], names.index(n))))
        rest.remove(order[-1])
    return order


def independent(predicates: Sequence[str], given: Sequence[str] = (), kinds: Mapping[str, str] | None = None) -> list[str]:
    """``predicates`` without the equalities that follow from ``given`` and the ones before them, as a.x = c.z from a.x = b.y and b.y = c.z.

    As join keys they would repeat a column. Spark packs two int keys into one long, and its hash of a long with equal
    halves takes few values: a broadcast table of n rows then needs some n * n steps.
    With ``kinds``, types by ``alias.column``, only columns of one type count, since casts can make equality intransitive.
    """
    parent: dict[str, str] = {}

    def root(c: str) -> str:
        while c in parent:
            c = parent[c]
        return c

    def adds(p: str) -> bool:
        if not (sides := EQUALITY.fullmatch(p)):
            return True
        a, b = ".".join(sides.group(1, 2)), ".".join(sides.group(3, 4))
        if kinds is not None and (a not in kinds or kinds[a] != kinds.get(b)):
            return True
        a, b = root(a), root(b)
        if a != b:
            parent[a] = b
        return a != b

    for p in given:
        adds(p)
    return [p for p in predicates if adds(p)]


def statistics(inputs: Mapping[str, DataFrame], predicates: Sequence[str]) -> dict[str, tuple[int, dict[str, int]]]:
    """By alias, the rows and the distinct values of each column that an equality uses, measured in one job."""
    columns: dict[str, set[str]] = {n: set() for n in inputs}
    for sides in filter(None, map(EQUALITY.fullmatch, predicates)):
        for n, c in (sides.group(1, 2), sides.group(3, 4)):
            columns.get(n, set()).add(c)
    wanted = {n: sorted(c) for n, c in columns.items()}
    counts = [
        df.agg(F.lit(n).alias("n"), F.count(F.lit(1)).alias("rows"), F.array(*(F.approx_count_distinct(F.col(f"{n}.{c}")) for c in wanted[n])).cast("array<long>").alias("values"))
        for n, df in inputs.items()
    ]
    return {r["n"]: (r["rows"], dict(zip(wanted[r["n"]], r["values"], strict=True))) for r in reduce(DataFrame.unionByName, counts).collect()}


def measured_order(names: Sequence[str], predicates: Sequence[str], stats: Mapping[str, tuple[int, Mapping[str, int]]], prefix: Sequence[str] = ()) -> list[str]:
    """``prefix``, then always the table whose join makes the fewest rows by the measured numbers; tables that no
    predicate connects come last. An equality keeps one in as many pairs as its richer side has values, any other
    predicate one in three."""

    def rows(n: str, bound: Sequence[str], before: float) -> tuple[bool, float, int]:
        keep, connected = 1.0, not bound
        for p in predicates:
            t = tables_of(p, [n, *bound])
            if n in t and len(t) > 1:
                connected = True
                sides = EQUALITY.fullmatch(p)
                keep /= max(1, *(stats[a][1].get(c, 1) for a, c in (sides.group(1, 2), sides.group(3, 4)))) if sides else 3
        return not connected, before * stats[n][0] * keep, names.index(n)

    order, so_far = [], 1.0
    for k in range(len(names)):
        left = [n for n in names if n not in order]
        n = prefix[k] if k < len(prefix) else min(left, key=lambda n: rows(n, order, so_far))
        so_far = rows(n, order, so_far)[1]
        order.append(n)
    return order


def _filtered(tables: Mapping[str, DataFrame], predicates: Sequence[str]) -> tuple[dict[str, DataFrame], list[tuple[str, frozenset[str]]]]:
    """The aliased tables under their own predicates, and every predicate with its tables."""
    refs = [(p, tables_of(p, list(tables))) for p in predicates]
    return {n: reduce(lambda d, p: d.filter(F.expr(p)), [p for p, t in refs if t == {n}], df.alias(n)) for n, df in tables.items()}, refs


def _steps(order: Sequence[str], inputs: Mapping[str, DataFrame], refs: Sequence[tuple[str, frozenset[str]]]) -> list[tuple[str, list[str]]]:
    """Each table behind the first with the predicates to attach when it is joined."""
    kinds = {f"{n}.{f.name}": f.dataType.json() for n, df in inputs.items() for f in df.schema.fields}
    out, bound, given = [], {order[0]}, [p for p, t in refs if len(t) == 1]
    for n in order[1:]:
        bound.add(n)
        ready = independent([p for p, t in refs if len(t) > 1 and n in t and t <= bound], given, kinds)
        given += ready
        out.append((n, ready))
    return out


def _attached(left: DataFrame, right: DataFrame, ready: Sequence[str]) -> DataFrame:
    return left.join(right, reduce(lambda a, b: a & b, map(F.expr, ready)), "inner") if ready else left.crossJoin(right)


def _columns_of(expression: str, names: Collection[str]) -> set[str]:
    """``alias.column`` of an expression, for the given aliases."""
    bare = QUOTED.sub("", expression)
    return {f"{t}.{c}" for t, c in re.findall(r"\b([A-Za-z_]\w*)\s*\.\s*(\w+|`[^`]+`)", bare) if t in names}


def multiway_join(
    tables: Mapping[str, DataFrame], predicates: Sequence[str], prefix: Sequence[str] = (), strategy: str | None = None, unique: Collection[str] = KEYS, measure: bool = False
) -> DataFrame:
    """N-way inner join on SQL predicates over aliased tables (``a.x = b.y``, theta and OR forms included).

    ``unique`` names columns without repeated values (``column`` or ``alias.column``); it guides the order alone.
    With ``measure`` the order follows rows and distinct values that a job counts in the filtered tables first: worth a
    pass over them where filters such as LIKE, or skewed keys, mislead the estimates from file sizes.

    Predicates on one table filter it before any join. Each other one is attached as soon as all its tables are
    bound, so equalities become join keys; one that those before it imply is left out. Columns stay reachable as ``alias.column``.
    """
    names, (inputs, refs) = list(tables), _filtered(tables, predicates)
    across = [p for p, t in refs if len(t) != 1]
    if measure:
        order = measured_order(names, across, statistics(inputs, across), prefix)
    else:
        order = join_order(names, across, {n: estimated_bytes(df) for n, df in inputs.items()}, prefix, unique)
    out = inputs[order[0]]
    for n, ready in _steps(order, inputs, refs):
        out = _attached(out, _hinted(inputs[n], strategy), ready)
    return reduce(lambda d, p: d.filter(F.expr(p)), [p for p, t in refs if not t], out)


def multiway_min(tables: Mapping[str, DataFrame], predicates: Sequence[str], outputs: Mapping[str, str], prefix: Sequence[str] = (), strategy: str | None = None) -> DataFrame:
    """One row with the MIN of each of ``outputs``, expressions in ``alias.column``, over the join of ``multiway_join`` with ``measure``.

    A minimum does not change if rows repeat. Before a join that can multiply rows, the tables joined so far are thus reduced to
    one row, with the minima so far, for each combination of the columns that predicates still need; so is the table that comes in where
    the measured numbers say that it has at least twice as many rows. Many facts of one key then never meet as all their pairs.
    """
    names, (inputs, refs) = list(tables), _filtered(tables, predicates)
    across = [p for p, t in refs if len(t) != 1]
    stats = statistics(inputs, across)
    order = measured_order(names, across, stats, prefix)
    steps = _steps(order, inputs, refs)
    held: set[str] = set()
    minimum = {o: f"_min_{k}" for k, o in enumerate(outputs)}

    def needed(bound: set[str], k: int) -> list[str]:
        """Columns of bound tables that steps from ``k`` on use, or outputs that need other tables too."""
        texts = [p for _, ready in steps[k:] for p in ready] + [e for e in outputs.values() if not tables_of(e, names) <= bound]
        return sorted({c for e in texts for c in _columns_of(e, bound)})

    def reduced(df: DataFrame, bound: set[str], k: int) -> DataFrame:
        keys = needed(bound, k)
        if not keys:
            return df
        old = [minimum[o] for o in outputs if o in held and tables_of(outputs[o], names) <= bound]
        new = [o for o, e in outputs.items() if o not in held and frozenset() < tables_of(e, names) <= bound]
        held.update(new)
        minima = [F.min(c).alias(c) for c in old] + [F.min(F.expr(outputs[o])).alias(minimum[o]) for o in new]
        return df.groupBy(*keys).agg(*minima) if minima else df.select(*keys).distinct()

    out, bound = inputs[order[0]], {order[0]}
    for k, (n, ready) in enumerate(steps):
        rows, values = stats[n]
        right = inputs[n]
        mine = [c for sides in filter(None, map(EQUALITY.fullmatch, ready)) for a, c in (sides.group(1, 2), sides.group(3, 4)) if a == n]
        if max((values[c] for c in mine), default=0) < 0.9 * rows:
            out = reduced(out, bound, k)
            if rows >= 2 * prod(values.get(c.partition(".")[2], rows) for c in needed({n}, k)):
                right = reduced(right, {n}, k)
        out = _attached(out, _hinted(right, strategy), ready)
        bound.add(n)
    out = reduce(lambda d, p: d.filter(F.expr(p)), [p for p, t in refs if not t], out)
    return out.agg(*(F.min(F.col(minimum[o]) if o in held else F.expr(e)).alias(o) for o, e in outputs.items()))
