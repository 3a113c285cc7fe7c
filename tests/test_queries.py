"""Every registered query of the engine's own operators against its SQL on DuckDB."""

import pytest

import __spark_entry__ as entry
from brindle.plans import catalogue, job, movies, skew, tpch

NAMES = [*tpch.PLANS, *tpch.MORE, *job.PLANS, *catalogue.PLANS, *skew.PLANS, *movies.PLANS]


@pytest.mark.parametrize("name", NAMES)
def test_query(name, spark, sf_dir, same):
    same(entry.queries()[name](spark, sf_dir), entry.oracle_sql()[name])


def test_entry(spark):
    assert entry.entry(spark).count() == 6


def test_every_query_has_a_plan_or_sql():
    assert set(NAMES) <= set(entry.queries()) and set(NAMES) <= set(entry.oracle_sql())
