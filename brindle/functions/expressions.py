"""Expressions as Spark columns: references, literals, comparison, logic, strings, arithmetic, aggregates.

All follow SQL's three-valued logic. Every function takes column names or columns; literals go through ``lit``.
"""

from __future__ import annotations

import datetime
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

Expr = Column | str


def col_ref(name: str, table: str | None = None) -> Column:
    """A column, of an aliased table where one is named. Computed columns are referred to by name as well."""
    return F.col(f"{table}.{name}" if table else name)


def _c(e: Expr) -> Column:
    return F.col(e) if isinstance(e, str) else e


def lit(value: object) -> Column:
    return F.lit(value)


def null(kind: str) -> Column:
    """A typed NULL."""
    return F.lit(None).cast(kind)


def date(year: int, month: int, day: int) -> Column:
    return F.lit(datetime.date(year, month, day))


def eq(a: Expr, b: Expr) -> Column:
    return _c(a) == _c(b)


def neq(a: Expr, b: Expr) -> Column:
    return _c(a) != _c(b)


def lt(a: Expr, b: Expr) -> Column:
    return _c(a) < _c(b)


def leq(a: Expr, b: Expr) -> Column:
    return _c(a) <= _c(b)


def gt(a: Expr, b: Expr) -> Column:
    return _c(a) > _c(b)


def geq(a: Expr, b: Expr) -> Column:
    return _c(a) >= _c(b)


def between(a: Expr, low: Expr, high: Expr) -> Column:
    """At least ``low`` and at most ``high``; negate it for NOT BETWEEN."""
    return and_(geq(a, low), leq(a, high))


def and_(*terms: Column) -> Column:
    return reduce(lambda a, b: a & b, terms)


def or_(*terms: Column) -> Column:
    return reduce(lambda a, b: a | b, terms)


def not_(a: Column) -> Column:
    return ~a


def is_null(a: Expr) -> Column:
    return _c(a).isNull()


def is_not_null(a: Expr) -> Column:
    return _c(a).isNotNull()


def in_(a: Expr, *values: object) -> Column:
    """Membership in a list of literals; an empty list holds nothing."""
    return _c(a).isin(list(values)) if values else F.lit(False)


def starts_with(a: Expr, prefix: str) -> Column:
    return _c(a).startswith(prefix)


def ends_with(a: Expr, suffix: str) -> Column:
    return _c(a).endswith(suffix)


def contains(a: Expr, part: str) -> Column:
    return _c(a).contains(part)


def like(a: Expr, pattern: str) -> Column:
    """SQL LIKE: ``%`` any run, ``_`` one character, backslash escapes."""
    return _c(a).like(pattern)


def matches(a: Expr, regex: str) -> Column:
    """Whether the whole string matches; NULL for NULL."""
    return _c(a).rlike(f"^(?:{regex})\\z")


def matches_or_false(a: Expr, regex: str) -> Column:
    """Compatibility form of ``matches``: FALSE for NULL, so its negation keeps NULL rows."""
    return F.coalesce(matches(a, regex), F.lit(False))


def add(a: Expr, b: Expr) -> Column:
    return _c(a) + _c(b)


def sub(a: Expr, b: Expr) -> Column:
    return _c(a) - _c(b)


def mul(a: Expr, b: Expr) -> Column:
    return _c(a) * _c(b)


def div(a: Expr, b: Expr) -> Column:
    """Division of doubles by IEEE rules: x / 0 is an infinity or NaN, where Spark's ANSI mode would fail."""
    x, y = _c(a).cast("double"), _c(b).cast("double")
    inf, nan = F.lit(float("inf")), F.lit(float("nan"))
    at_zero = F.when((x == 0) | F.isnan(x), nan).when(x > 0, inf).otherwise(-inf)
    return F.when(x.isNull() | y.isNull(), null("double")).when(y == 0, at_zero).otherwise(F.try_divide(x, y))


def safe_div(a: Expr, b: Expr) -> Column:
    """Division that is NULL where the divisor is 0."""
    return F.try_divide(_c(a).cast("double"), _c(b).cast("double"))


def float_(a: Expr) -> Column:
    return _c(a).cast("double")


def extract_year(a: Expr) -> Column:
    return F.year(_c(a))


def case(cond: Column, then: Expr, otherwise: Expr) -> Column:
    """One branch; nest for more. A NULL condition takes the other branch."""
    return F.when(cond, _c(then)).otherwise(_c(otherwise))


def sum_(a: Expr) -> Column:
    return F.sum(_c(a))


def avg(a: Expr) -> Column:
    return F.avg(_c(a))


def min_(a: Expr) -> Column:
    return F.min(_c(a))


def max_(a: Expr) -> Column:
    return F.max(_c(a))


def count(a: Expr | None = None) -> Column:
    """Non-NULL values, or rows where nothing is named."""
    return F.count(F.lit(1) if a is None else _c(a))


def count_or_null(a: Expr | None = None) -> Column:
    """Compatibility form of ``count`` for keyless aggregation: NULL where there are no rows at all."""
    return F.when(F.count(F.lit(1)) > 0, count(a))
