"""Expression layer: column helpers under one namespace."""

from brindle.functions.expressions import (
    add, and_, avg, between, case, col_ref, contains, count, count_or_null, date, div, ends_with, eq, extract_year, float_, geq, gt, in_, is_not_null, is_null, leq, like, lit, lt,
    matches, matches_or_false, max_, min_, mul, neq, not_, null, or_, safe_div, starts_with, sub, sum_,
)

__all__ = [
    "add", "and_", "avg", "between", "case", "col_ref", "contains", "count", "count_or_null", "date", "div", "ends_with", "eq", "extract_year", "float_", "geq", "gt", "in_", "is_not_null",
    "is_null", "leq", "like", "lit", "lt", "matches", "matches_or_false", "max_", "min_", "mul", "neq", "not_", "null", "or_", "safe_div", "starts_with", "sub", "sum_",
]
