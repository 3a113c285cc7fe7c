"""Scans, filters, projections and the text sink."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DateType, DoubleType, FloatType


def scan(table: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The listed columns; the file scan reads no others."""
    return table.select(*columns)


def select(df: DataFrame, condition: Column) -> DataFrame:
    """Rows for which the condition is true; a NULL condition drops the row."""
    return df.filter(condition)


def project(df: DataFrame, columns: Mapping[str, Column | str]) -> DataFrame:
    """Named expressions, in order."""
    return df.select(*((F.col(e) if isinstance(e, str) else e).alias(name) for name, e in columns.items()))


def scan_select(table: DataFrame, columns: Sequence[str], conjuncts: Sequence[Column]) -> DataFrame:
    """Rows that satisfy all conjuncts, then the listed columns: comparisons with literals reach the file scan."""
    return reduce(DataFrame.filter, conjuncts, table).select(*columns)


def vector_select(table: DataFrame, columns: Sequence[str], filters: Mapping[str, Sequence[tuple[str, object]]], conjunction: bool = True) -> DataFrame:
    """Comparisons of columns with literals, given by column as (operator, value), joined by AND or by OR."""
    compare = {
        "=": lambda c, v: c == v, "<>": lambda c, v: c != v, "<": lambda c, v: c < v,
        "<=": lambda c, v: c <= v, ">": lambda c, v: c > v, ">=": lambda c, v: c >= v,
    }
    terms = [compare[op](F.col(name), F.lit(value)) for name, tests in filters.items() for op, value in tests]
    if not terms:
        return table.select(*columns)
    return table.filter(reduce(lambda a, b: a & b if conjunction else a | b, terms)).select(*columns)


def output(df: DataFrame, name: str = "line") -> DataFrame:
    """Each row as text: every value followed by ``|``, NULL empty, booleans t or f, doubles with six digits, inf or nan."""

    def text(f) -> Column:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, BooleanType):
            c = F.when(c, "t").when(~c, "f")
        elif isinstance(f.dataType, (DoubleType, FloatType)):
            c = F.when(F.isnan(c), "nan").when(c == float("inf"), "inf").when(c == float("-inf"), "-inf").otherwise(F.format_string("%.6f", c))
        elif isinstance(f.dataType, DateType):
            c = F.concat_ws("-", F.year(c).cast("string"), F.lpad(F.month(c).cast("string"), 2, "0"), F.lpad(F.dayofmonth(c).cast("string"), 2, "0"))
        return F.concat(F.when(F.col(f"`{f.name}`").isNull(), "").otherwise(c.cast("string")), F.lit("|"))

    return df.select(F.concat(*(text(f) for f in df.schema)).alias(name))
