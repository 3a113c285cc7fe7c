"""Plan operators over DataFrames."""

from brindle.operators.aggregates import aggregate, group_by_aggregate
from brindle.operators.joins import cross_product, hash_join, multiway_join, multiway_min, scalar_cross
from brindle.operators.scans import output, project, scan, scan_select, select, vector_select
from brindle.operators.sorting import numbered, order_by, ranked

__all__ = [
    "aggregate", "cross_product", "group_by_aggregate", "hash_join", "multiway_join", "multiway_min", "numbered", "order_by", "output", "project", "ranked", "scalar_cross", "scan", "scan_select", "select", "vector_select",
]
