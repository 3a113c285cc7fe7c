"""Many-way joins on the movie schema: delimited files in, MIN queries out, compared with DuckDB."""

import csv
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from brindle.operators import aggregate, multiway_join, multiway_min
from brindle.plans.movies import joined, parts
from brindle.plans.sql import run_sql
from brindle.sources import read_delimited, write_columnar
from brindle.tables import MOVIE_SCHEMAS, Database

WORDS = ["sequel", "murder", "(co-production)", "(presents)", "a_b", "top 250", 'say "hi"', "x, y", "The Movie", "B", "m%", "budget"]


def value(rng, column, kind, row):
    if column == "id":
        return row + 1
    if rng.random() < 0.1:
        return None
    if column == "production_year":
        return rng.randrange(1950, 2015)
    return rng.randrange(1, 40) if kind == "int" else rng.choice(WORDS)


@pytest.fixture(scope="module")
def movies(spark, tmp_path_factory):
    """Every table as a comma-separated file with backslash escapes, loaded and stored as Parquet."""
    rng, root = random.Random(15), tmp_path_factory.mktemp("movies")
    con = duckdb.connect()
    for table, ddl in MOVIE_SCHEMAS.items():
        columns = [c.split() for c in ddl.split(", ")]
        n = 40 if len(columns) < 4 else 150
        with open(root / f"{table}.csv", "w", newline="") as f:
            out = csv.writer(f, quoting=csv.QUOTE_STRINGS, escapechar="\\", doublequote=False)
            out.writerows([[value(rng, c, k, i) for c, k in columns] for i in range(n)])
        write_columnar(read_delimited(spark, str(root / f"{table}.csv"), table, sep=","), str(root / f"{table}.parquet"))
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{root}/{table}.parquet/*.parquet'")
    return Database(spark, str(root), tables=MOVIE_SCHEMAS), con


QUERIES = [
    (
        {"t": "title", "mc": "movie_companies", "cn": "company_name", "ct": "company_type"},
        ["t.id = mc.movie_id", "mc.company_id = cn.id", "ct.id = mc.company_type_id", "mc.note NOT LIKE '%(presents)%'", "cn.country_code IS NOT NULL"],
        {"name": "cn.name", "title": "t.title", "year": "t.production_year"},
    ),
    (
        {"k": "keyword", "mk": "movie_keyword", "t": "title", "ci": "cast_info", "n": "name", "rt": "role_type", "mi": "movie_info"},
        [
            "k.id = mk.keyword_id", "t.id = mk.movie_id", "t.id = ci.movie_id", "ci.movie_id = mk.movie_id", "n.id = ci.person_id", "rt.id = ci.role_id", "mi.movie_id = t.id",
            "k.keyword IN ('sequel', 'murder', 'B')", "t.production_year BETWEEN 1960 AND 2010", "n.name LIKE '%a%' OR n.gender IS NULL", "mi.note IS NULL OR mi.info > 'M'",
        ],
        {"keyword": "k.keyword", "who": "n.name", "what": "mi.info"},
    ),
    (
        {"ml": "movie_link", "lt": "link_type", "t1": "title", "t2": "title", "kt1": "kind_type", "kt2": "kind_type", "mi1": "movie_info_idx", "mi2": "movie_info_idx", "it1": "info_type", "it2": "info_type"},
        [
            "lt.id = ml.link_type_id", "t1.id = ml.movie_id", "t2.id = ml.linked_movie_id", "kt1.id = t1.kind_id", "kt2.id = t2.kind_id", "mi1.movie_id = t1.id",
            "mi2.movie_id = t2.id", "it1.id = mi1.info_type_id", "it2.id = mi2.info_type_id", "mi2.info < 'z'", "t1.production_year < t2.production_year", "lt.link <> 'B'",
        ],
        {"first": "t1.title", "second": "t2.title", "rating": "mi2.info"},
    ),
]


@pytest.mark.parametrize("tables, predicates, outputs", QUERIES)
def test_many_way_join(movies, tables, predicates, outputs):
    db, con = movies
    sql = f"SELECT {', '.join(f'MIN({e}) AS {n}' for n, e in outputs.items())} FROM {', '.join(f'{t} AS {a}' for a, t in tables.items())} WHERE {' AND '.join(f'({p})' for p in predicates)}"
    (want,) = con.sql(sql).fetchall()
    inputs = {a: db[t] for a, t in tables.items()}
    orders = [(), tuple(tables)[-1:], tuple(tables)[:2]]
    for prefix in orders:
        joined = multiway_join(inputs, predicates, prefix=prefix, unique={f"{a}.id" for a in tables})
        assert tuple(aggregate(joined, {n: F.min(e) for n, e in outputs.items()}).first()) == want
    assert tuple(run_sql(db, sql)[0].first()) == want


@pytest.mark.parametrize("tables, predicates, outputs", QUERIES)
def test_many_way_minimum(movies, tables, predicates, outputs):
    """Also of expressions on two tables, on none, and with tables that equalities do not reach."""
    db, con = movies
    names = list(tables)
    outputs = outputs | {"both": f"least({names[0]}.id + {names[-1]}.id, {names[1]}.id)", "one": "1", "texts": f"concat({names[1]}.id, '{names[0]}.id')"}
    more = [*predicates, f"{names[0]}.id + {names[-1]}.id > free.id", "free.id < 4"]
    sql = f"SELECT {', '.join(f'MIN({e}) AS {n}' for n, e in outputs.items())} FROM {', '.join(f'{t} AS {a}' for a, t in tables.items())}, link_type AS free WHERE {' AND '.join(f'({p})' for p in more)}"
    (want,) = con.sql(sql).fetchall()
    inputs = {a: db[t] for a, t in (tables | {"free": "link_type"}).items()}
    for prefix in [(), tuple(tables)[-1:], ("free", *tables)]:
        out = multiway_min(inputs, more, outputs, prefix)
        assert out.columns == list(outputs) and tuple(out.first()) == want
    assert tuple(multiway_min(inputs, [*more, "1 = 2"], outputs).first()) == (None,) * len(outputs)


def most_joined(df):
    """The most rows that one join made while the query ran."""
    df.collect()
    todo, most = [df._jdf.queryExecution().executedPlan()], 0
    while todo:
        p = todo.pop()
        if p.nodeName() == "AdaptiveSparkPlan":
            todo.append(p.executedPlan())
        elif "QueryStage" in p.nodeName():
            todo.append(p.plan())
        else:
            if "Join" in p.nodeName():
                most = max(most, p.metrics().apply("numOutputRows").value())
            todo += [p.children().apply(k) for k in range(p.children().size())]
    return most


def test_facts_of_one_title_do_not_meet_in_pairs(spark):
    """Three tables with 100 rows a title: a million rows for each of 5 titles where all combinations are joined."""
    rows = {
        "title": spark.range(1, 6).selectExpr("id", "concat('t', id) title"),
        "movie_companies": spark.range(500).selectExpr("id", "id % 5 + 1 movie_id", "1L company_id", "1L company_type_id", "'x' note"),
        "movie_keyword": spark.range(500).selectExpr("id", "id % 5 + 1 movie_id", "1L keyword_id"),
        "movie_link": spark.range(500).selectExpr("id", "id % 5 + 1 movie_id", "1L link_type_id"),
        "company_name": spark.sql("SELECT 1L id, 'c' name, '[us]' country_code"), "company_type": spark.sql("SELECT 1L id, 'distributors' kind"),
        "keyword": spark.sql("SELECT 1L id, 'sequel' keyword"), "link_type": spark.sql("SELECT 1L id, 'follows' link"),
    }
    out = joined({a: rows[t] for a, t in parts("movies_links")[0].items()}, "movies_links")
    assert most_joined(out) <= 500 and tuple(out.first()) == ("c", "follows", "t1")


def test_files_are_read_as_written(movies):
    db, _ = movies
    texts = {r.keyword for r in db["keyword"].collect()}
    assert 'say "hi"' in texts and "x, y" in texts and None in texts
