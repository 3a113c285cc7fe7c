"""Plans as text and as JSON."""

from __future__ import annotations

import json
import re

from pyspark.sql import DataFrame


def plan_json(df: DataFrame) -> list[dict]:
    """The optimized logical plan: its nodes in pre-order, each with its class, arguments and number of children."""
    return json.loads(df._jdf.queryExecution().optimizedPlan().toJSON())


def plan_text(df: DataFrame) -> str:
    """The physical plan that is to run."""
    return df._jdf.queryExecution().executedPlan().toString()


def scans(df: DataFrame) -> list[tuple[list[str], list[str]]]:
    """The columns that each file scan of the physical plan reads, and the filters that it was handed."""
    out = []
    for line in df._jdf.queryExecution().executedPlan().toString().splitlines():
        if "ReadSchema: struct<" in line:
            read = re.search(r"ReadSchema: struct<(.*)>", line)[1]
            pushed = re.search(r"PushedFilters: \[(.*?)\](?:, |$)", line)
            out.append(([c.split(":")[0] for c in read.split(",")] if read else [], [f for f in re.split(r", (?=[A-Z])", pushed[1]) if f] if pushed else []))
    return out
