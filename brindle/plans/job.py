"""Many-way join queries: MIN aggregates over four to nine tables under selective filters, and SQL entry."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.operators import aggregate, multiway_join
from brindle.plans.sql import run_sql
from brindle.tables import Database

#: name: (alias -> table, predicates, output -> expression under MIN). Predicates are SQL that both engines read.
STARS: dict[str, tuple[dict[str, str], list[str], dict[str, str]]] = {
    "job_four_tables": (
        {"c": "customer", "o": "orders", "l": "lineitem", "p": "part"},
        [
            "c.c_custkey = o.o_custkey", "o.o_orderkey = l.l_orderkey", "l.l_partkey = p.p_partkey",
            "p.p_name LIKE 'small%'", "c.c_mktsegment IN ('BUILDING', 'MACHINERY')",
        ],
        {"customer_name": "c.c_name", "part_name": "p.p_name", "least_price": "l.l_extendedprice"},
    ),
    "job_five_tables_or": (
        {"s": "supplier", "n": "nation", "l": "lineitem", "p": "part", "o": "orders"},
        [
            "s.s_nationkey = n.n_nationkey", "l.l_suppkey = s.s_suppkey", "l.l_partkey = p.p_partkey", "o.o_orderkey = l.l_orderkey",
            "p.p_name LIKE '%widget' OR p.p_name LIKE '%ring%'", "n.n_name NOT LIKE 'NATION_1%'", "p.p_size BETWEEN 5 AND 15",
        ],
        {"supplier_name": "s.s_name", "order_key": "o.o_orderkey"},
    ),
    "job_six_tables_cycle": (
        {"c": "customer", "o": "orders", "l": "lineitem", "s": "supplier", "n": "nation", "r": "region"},
        [
            "c.c_custkey = o.o_custkey", "o.o_orderkey = l.l_orderkey", "l.l_suppkey = s.s_suppkey", "c.c_nationkey = s.s_nationkey",
            "s.s_nationkey = n.n_nationkey", "n.n_regionkey = r.r_regionkey", "r.r_name IN ('ASIA', 'EUROPE')", "o.o_orderstatus IS NOT NULL",
        ],
        {"nation": "n.n_name", "least_balance": "c.c_acctbal", "first_price": "o.o_totalprice"},
    ),
    "job_nine_tables": (
        {"c": "customer", "o": "orders", "l": "lineitem", "p": "part", "s": "supplier", "n1": "nation", "n2": "nation", "r1": "region", "r2": "region"},
        [
            "c.c_custkey = o.o_custkey", "o.o_orderkey = l.l_orderkey", "l.l_partkey = p.p_partkey", "l.l_suppkey = s.s_suppkey",
            "c.c_nationkey = n1.n_nationkey", "s.s_nationkey = n2.n_nationkey", "n1.n_regionkey = r1.r_regionkey", "n2.n_regionkey = r2.r_regionkey",
            "r1.r_regionkey < r2.r_regionkey", "p.p_brand = 'Brand#12' OR n1.n_name = 'NATION_3'", "o.o_orderpriority IS NOT NULL",
        ],
        {"from_region": "r1.r_name", "to_region": "r2.r_name", "part_name": "p.p_name", "least_quantity": "l.l_quantity"},
    ),
}


def star_sql(name: str) -> str:
    tables, predicates, outputs = STARS[name]
    chosen = ", ".join(f"MIN({e}) AS {n}" for n, e in outputs.items())
    return f"SELECT {chosen} FROM {', '.join(f'{t} AS {a}' for a, t in tables.items())} WHERE {' AND '.join(f'({p})' for p in predicates)}"


def star(db: Database, name: str, prefix: tuple[str, ...] = (), strategy: str | None = None, measure: bool = False) -> DataFrame:
    """The query as one multi-way join under a keyless aggregate."""
    tables, predicates, outputs = STARS[name]
    joined = multiway_join({a: db[t] for a, t in tables.items()}, predicates, prefix, strategy, measure=measure)
    return aggregate(joined, {n: F.min(e) for n, e in outputs.items()})


def star_by_sql(db: Database, name: str) -> DataFrame:
    """The same through the SQL entry point."""
    return run_sql(db, star_sql(name) + ";")[0]


def _plan(name: str) -> Callable[[Database], DataFrame]:
    return lambda db: star(db, name)


PLANS = {name: _plan(name) for name in STARS}
