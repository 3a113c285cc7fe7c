"""The decision-support plans and many-way joins on skewed keys: one customer, part, supplier and order draw a share of the rows."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.plans import job, tpch
from brindle.tables import Database

#: Keys by table, as SQL that both engines read: a third of the orders are one customer's, and so on.
HOT = {
    "orders": {"o_custkey": "CASE WHEN o_orderkey % 3 = 0 THEN 1 ELSE o_custkey END"},
    "lineitem": {
        "l_partkey": "CASE WHEN l_linenumber % 4 = 1 THEN 1 ELSE l_partkey END",
        "l_suppkey": "CASE WHEN l_orderkey % 3 = 1 THEN 1 ELSE l_suppkey END",
        "l_orderkey": "CASE WHEN l_orderkey % 7 = 0 THEN 7 ELSE l_orderkey END",
    },
}


class SkewedDatabase(Database):
    """The same tables with the keys of HOT."""

    def __getitem__(self, name: str) -> DataFrame:
        df = super().__getitem__(name)
        return df.withColumns({c: F.expr(e).cast(df.schema[c].dataType) for c, e in HOT.get(name, {}).items()})


def skewed_sql(sql: str) -> str:
    """``sql`` over the skewed tables."""
    tables = []
    for table, columns in HOT.items():
        sql = re.sub(rf"\b{table}\b", f"skewed_{table}", sql)
        tables.append(f"skewed_{table} AS (SELECT * REPLACE ({', '.join(f'{e} AS {c}' for c, e in columns.items())}) FROM {table})")
    rest = sql.strip()
    return f"WITH {', '.join(tables)}" + (f", {rest[5:]}" if rest.upper().startswith("WITH ") else f" {rest}")


def _on(plan: Callable[[Database], DataFrame]) -> Callable[[Database], DataFrame]:
    return lambda db: plan(SkewedDatabase(db.spark, db.dir))


PLANS = {f"skewed_{name}": _on(plan) for name, plan in (tpch.PLANS | job.PLANS).items()}
SQL = {f"skewed_{name}": skewed_sql(sql) for name, sql in (tpch.SQL | {n: job.star_sql(n) for n in job.STARS}).items()}
