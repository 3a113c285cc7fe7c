"""The many-way join workload on the 21 movie tables, which are views of the star tables.

A query is a MIN aggregate over a join of up to 17 aliased tables. Its graph follows the families of the public
join-order benchmark: a title amid fact tables that all carry its id, each with a dimension or two behind it. Filters
suit the generated values.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame

from brindle.operators import multiway_min
from brindle.tables import MOVIE_SCHEMAS, Database


def _pick(value: str, *texts: str | None) -> str:
    """One of the texts by ``value``'s remainder."""
    cases = " ".join(f"WHEN {k} THEN {'NULL' if t is None else repr(t)}" for k, t in enumerate(texts))
    return f"CASE {value} % {len(texts)} {cases} END"


#: name: (columns with their expressions, FROM and WHERE). Columns that a query never uses are NULL. Lines of an order
#: are dealt to the fact tables by their number, so that each title has a few rows in each.
VIEWS: dict[str, tuple[dict[str, str], str]] = {
    "title": ({"id": "p_partkey + 1", "title": "p_name", "kind_id": "p_size % 7 + 1", "production_year": "CASE WHEN p_partkey % 11 = 0 THEN NULL ELSE 1950 + p_partkey * 7 % 65 END", "episode_nr": "p_size"}, "part"),
    "kind_type": ({"id": "n_nationkey + 1", "kind": _pick("n_nationkey", "movie", "tv series", "tv movie", "video movie", "tv mini series", "video game", "episode")}, "nation WHERE n_nationkey < 7"),
    "name": ({"id": "c_custkey + 1", "name": "c_name", "gender": _pick("c_custkey", "f", "m", "m", None), "name_pcode_cf": "c_mktsegment"}, "customer"),
    "aka_name": ({"id": "c_custkey + 1", "person_id": "c_custkey + 1 - c_custkey % 3", "name": "c_mktsegment"}, "customer"),
    "aka_title": ({"id": "p_partkey + 1", "movie_id": "p_partkey + 1 - p_partkey % 3", "title": "p_type"}, "part"),
    "char_name": ({"id": "s_suppkey + 1", "name": "s_name"}, "supplier"),
    "company_name": ({"id": "s_suppkey + 1", "name": "s_name", "country_code": _pick("s_nationkey", "[us]", "[gb]", "[de]", "[fr]", None)}, "supplier"),
    "company_type": ({"id": "r_regionkey + 1", "kind": _pick("r_regionkey", "production companies", "distributors", "special effects companies", "miscellaneous companies", "studios")}, "region"),
    "keyword": ({"id": "n_nationkey + 1", "keyword": _pick("n_nationkey", "sequel", "murder", "character-name", "blood", "revenge", "fight", "based-on-novel")}, "nation"),
    "info_type": ({"id": "n_nationkey + 1", "info": _pick("n_nationkey", "rating", "genres", "release dates", "budget", "votes", "countries", "languages", "trivia")}, "nation WHERE n_nationkey < 8"),
    "link_type": ({"id": "r_regionkey + 1", "link": _pick("r_regionkey", "follows", "followed by", "remake of", "features", "spoofs")}, "region"),
    "role_type": ({"id": "r_regionkey + 1", "role": _pick("r_regionkey", "actor", "actress", "producer", "writer", "director")}, "region"),
    "comp_cast_type": ({"id": "r_regionkey + 1", "kind": _pick("r_regionkey", "cast", "crew", "complete", "complete+verified")}, "region WHERE r_regionkey < 4"),
    "movie_companies": ({"id": "l_orderkey", "movie_id": "l_partkey + 1", "company_id": "l_suppkey + 1", "company_type_id": "l_orderkey % 5 + 1", "note": _pick("l_orderkey", "(presents)", "(co-production)", "(200x) (USA)", None)}, "lineitem WHERE l_linenumber = 1"),
    "movie_keyword": ({"id": "l_orderkey", "movie_id": "l_partkey + 1", "keyword_id": "l_suppkey % 25 + 1"}, "lineitem WHERE l_linenumber = 2"),
    "cast_info": ({"id": "l_orderkey", "person_id": "o_custkey + 1", "movie_id": "l_partkey + 1", "person_role_id": "l_suppkey + 1", "note": _pick("l_orderkey", "(voice)", "(uncredited)", None, "(producer)", "(writer)"), "role_id": "l_orderkey % 5 + 1"}, "lineitem, orders WHERE l_orderkey = o_orderkey AND l_linenumber = 3"),
    "movie_info": ({"id": "l_orderkey", "movie_id": "l_partkey + 1", "info_type_id": "l_suppkey % 8 + 1", "info": _pick("l_orderkey", "Drama", "Horror", "USA: 1998", "Germany", "Sweden", "English"), "note": _pick("l_suppkey", None, "internet", "uncertain")}, "lineitem WHERE l_linenumber = 4"),
    "movie_info_idx": ({"id": "l_orderkey", "movie_id": "l_partkey + 1", "info_type_id": "l_suppkey % 8 + 1", "info": _pick("l_orderkey", "1.5", "3.2", "4.8", "6.1", "7.9", "9.3")}, "lineitem WHERE l_linenumber = 5"),
    "movie_link": ({"id": "p_partkey + 1", "movie_id": "p_partkey + 1", "linked_movie_id": "p_partkey + 1 - p_partkey % 13", "link_type_id": "p_size % 5 + 1"}, "part"),
    "complete_cast": ({"id": "p_partkey + 1", "movie_id": "p_partkey + 1 - p_partkey % 2", "subject_id": "p_size % 2 + 1", "status_id": "p_size % 2 + 3"}, "part"),
    "person_info": ({"id": "c_custkey + 1", "person_id": "c_custkey + 1 - c_custkey % 2", "info_type_id": "c_nationkey % 8 + 1", "info": "c_mktsegment", "note": _pick("c_nationkey", "Volker Boehm", None, "anonymous")}, "customer"),
}


def view_sql(table: str) -> str:
    """A movie table in its fixed columns and types."""
    columns, source = VIEWS[table]
    kinds = {"int": "INTEGER", "string": "VARCHAR(9999)"}
    names = (c.split() for c in MOVIE_SCHEMAS[table].split(", "))
    return f"SELECT {', '.join(f'CAST({columns.get(c, "NULL")} AS {kinds[k]}) AS {c}' for c, k in names)} FROM {source}"


class MovieDatabase(Database):
    """The movie tables over the star tables of a folder."""

    def __init__(self, spark, sf_dir: str):
        super().__init__(spark, sf_dir)
        self.register()

    def __getitem__(self, name: str) -> DataFrame:
        return self.spark.sql(view_sql(name).replace("VARCHAR(9999)", "STRING")) if name in VIEWS else super().__getitem__(name)


#: name: (aliases and tables, equalities, filters, MIN outputs). ``a=b=c`` stands for all pairs of its sides.
QUERIES: dict[str, tuple[str, str, list[str], dict[str, str]]] = {
    "movies_company_rating": (
        "ct company_type, it info_type, mc movie_companies, mx movie_info_idx, t title",
        "ct.id=mc.company_type_id t.id=mc.movie_id=mx.movie_id it.id=mx.info_type_id",
        ["ct.kind = 'production companies'", "it.info = 'rating'", "mc.note NOT LIKE '%(presents)%' OR mc.note IS NULL"],
        {"note": "mc.note", "title": "t.title", "year": "t.production_year"},
    ),
    "movies_company_keyword": (
        "cn company_name, k keyword, mc movie_companies, mk movie_keyword, t title",
        "cn.id=mc.company_id t.id=mc.movie_id=mk.movie_id k.id=mk.keyword_id",
        ["cn.country_code = '[de]'", "k.keyword = 'sequel'"],
        {"title": "t.title"},
    ),
    "movies_info_by_year": (
        "k keyword, mi movie_info, mk movie_keyword, t title",
        "t.id=mi.movie_id=mk.movie_id k.id=mk.keyword_id",
        ["k.keyword LIKE '%sequel%'", "mi.info IN ('Germany', 'Sweden', 'English')", "t.production_year > 1990"],
        {"title": "t.title", "info": "mi.info"},
    ),
    "movies_keyword_rating": (
        "it info_type, k keyword, mx movie_info_idx, mk movie_keyword, t title",
        "t.id=mk.movie_id=mx.movie_id k.id=mk.keyword_id it.id=mx.info_type_id",
        ["it.info = 'votes'", "k.keyword LIKE '%e%'", "mx.info > '3'", "t.production_year BETWEEN 1960 AND 2005"],
        {"rating": "mx.info", "title": "t.title"},
    ),
    "movies_cast_keyword": (
        "ci cast_info, k keyword, mk movie_keyword, n name, t title",
        "k.id=mk.keyword_id t.id=mk.movie_id=ci.movie_id n.id=ci.person_id",
        ["k.keyword IN ('murder', 'blood', 'revenge')", "n.name LIKE '%7%'", "t.production_year > 1980"],
        {"keyword": "k.keyword", "person": "n.name", "title": "t.title"},
    ),
    "movies_biography": (
        "an aka_name, ci cast_info, it info_type, lt link_type, ml movie_link, n name, pi person_info, t title",
        "n.id=an.person_id=pi.person_id=ci.person_id t.id=ci.movie_id=ml.linked_movie_id lt.id=ml.link_type_id it.id=pi.info_type_id",
        ["an.name LIKE '%A%'", "it.info LIKE '%r%'", "lt.link IN ('features', 'follows')", "n.gender = 'm' OR n.gender = 'f' AND n.name LIKE 'C%'", "pi.note IS NOT NULL", "t.production_year BETWEEN 1955 AND 2010"],
        {"person": "n.name", "title": "t.title"},
    ),
    "movies_voice": (
        "an aka_name, ci cast_info, cn company_name, mc movie_companies, n name, rt role_type, t title",
        "an.person_id=n.id=ci.person_id t.id=ci.movie_id=mc.movie_id cn.id=mc.company_id rt.id=ci.role_id",
        ["ci.note LIKE '(%'", "cn.country_code IS NOT NULL", "rt.role IN ('actress', 'actor')"],
        {"alias": "an.name", "title": "t.title"},
    ),
    "movies_character": (
        "an aka_name, chn char_name, ci cast_info, cn company_name, mc movie_companies, n name, rt role_type, t title",
        "chn.id=ci.person_role_id n.id=an.person_id=ci.person_id t.id=ci.movie_id=mc.movie_id cn.id=mc.company_id rt.id=ci.role_id",
        ["ci.note IN ('(voice)', '(uncredited)')", "cn.country_code = '[us]'", "n.gender = 'm'", "t.production_year BETWEEN 1960 AND 2014"],
        {"alias": "an.name", "character": "chn.name", "title": "t.title"},
    ),
    "movies_links": (
        "cn company_name, ct company_type, k keyword, lt link_type, mc movie_companies, mk movie_keyword, ml movie_link, t title",
        "lt.id=ml.link_type_id t.id=ml.movie_id=mk.movie_id=mc.movie_id k.id=mk.keyword_id ct.id=mc.company_type_id cn.id=mc.company_id",
        ["cn.country_code <> '[fr]'", "ct.kind = 'distributors'", "k.keyword = 'sequel' OR k.keyword = 'fight'", "lt.link LIKE '%follow%'", "mc.note IS NULL OR mc.note <> '(presents)'"],
        {"company": "cn.name", "link": "lt.link", "title": "t.title"},
    ),
    "movies_kinds": (
        "cn company_name, ct company_type, ia info_type, ib info_type, kt kind_type, mc movie_companies, mi movie_info, mx movie_info_idx, t title",
        "mi.movie_id=t.id=mc.movie_id=mx.movie_id kt.id=t.kind_id cn.id=mc.company_id ct.id=mc.company_type_id ia.id=mi.info_type_id ib.id=mx.info_type_id",
        ["kt.kind <> 'episode'", "ia.info <> ib.info", "mx.info < '8'", "cn.country_code IN ('[us]', '[gb]', '[de]')"],
        {"released": "mi.info", "rating": "mx.info", "title": "t.title"},
    ),
    "movies_alias_titles": (
        "alt aka_title, cn company_name, ct company_type, it info_type, k keyword, mc movie_companies, mi movie_info, mk movie_keyword, t title",
        "t.id=alt.movie_id=mi.movie_id=mk.movie_id=mc.movie_id k.id=mk.keyword_id it.id=mi.info_type_id cn.id=mc.company_id ct.id=mc.company_type_id",
        ["mi.note LIKE '%inter%'", "it.info NOT IN ('budget')", "t.production_year > 1970"],
        {"info": "mi.info", "alias": "alt.title", "title": "t.title"},
    ),
    "movies_persons": (
        "ci cast_info, cn company_name, k keyword, mc movie_companies, mk movie_keyword, n name, t title",
        "n.id=ci.person_id t.id=ci.movie_id=mk.movie_id=mc.movie_id k.id=mk.keyword_id cn.id=mc.company_id",
        ["k.keyword = 'character-name'", "n.name LIKE '%1%'"],
        {"person": "n.name"},
    ),
    "movies_budget_votes": (
        "ci cast_info, ia info_type, ib info_type, mi movie_info, mx movie_info_idx, n name, t title",
        "t.id=mi.movie_id=mx.movie_id=ci.movie_id n.id=ci.person_id ia.id=mi.info_type_id ib.id=mx.info_type_id",
        ["ci.note IN ('(producer)', '(writer)')", "n.gender = 'm'", "mi.info <> 'Horror' OR mi.note IS NULL", "ia.info < ib.info"],
        {"info": "mi.info", "votes": "mx.info", "title": "t.title"},
    ),
    "movies_complete_cast": (
        "cc complete_cast, ca comp_cast_type, cb comp_cast_type, chn char_name, ci cast_info, k keyword, kt kind_type, mk movie_keyword, n name, t title",
        "kt.id=t.kind_id t.id=mk.movie_id=ci.movie_id=cc.movie_id chn.id=ci.person_role_id n.id=ci.person_id k.id=mk.keyword_id ca.id=cc.subject_id cb.id=cc.status_id",
        ["ca.kind = 'cast'", "cb.kind LIKE '%complete%'", "kt.kind IN ('movie', 'tv movie', 'video movie')", "n.name LIKE '%2%' OR chn.name LIKE '%3%'"],
        {"character": "chn.name", "title": "t.title"},
    ),
    "movies_seventeen_tables": (
        "an aka_name, cc complete_cast, ca comp_cast_type, cb comp_cast_type, chn char_name, ci cast_info, cn company_name, ia info_type, ib info_type, k keyword, "
        "mc movie_companies, mi movie_info, mk movie_keyword, n name, pi person_info, rt role_type, t title",
        "t.id=mi.movie_id=mc.movie_id=ci.movie_id=mk.movie_id=cc.movie_id cn.id=mc.company_id ia.id=mi.info_type_id n.id=ci.person_id=an.person_id=pi.person_id rt.id=ci.role_id "
        "chn.id=ci.person_role_id ib.id=pi.info_type_id k.id=mk.keyword_id ca.id=cc.subject_id cb.id=cc.status_id",
        ["ca.kind = 'cast'", "n.gender IS NOT NULL", "mi.info IS NOT NULL AND (mi.info LIKE '%e%' OR mi.info LIKE 'USA%')", "t.production_year BETWEEN 1950 AND 2012"],
        {"character": "chn.name", "person": "n.name", "title": "t.title"},
    ),
    "movies_linked_pairs": (
        "ca company_name, cb company_name, ia info_type, ib info_type, ka kind_type, kb kind_type, lt link_type, ma movie_companies, mb movie_companies, xa movie_info_idx, xb movie_info_idx, "
        "ml movie_link, ta title, tb title",
        "lt.id=ml.link_type_id ta.id=ml.movie_id=xa.movie_id=ma.movie_id tb.id=ml.linked_movie_id=xb.movie_id=mb.movie_id ia.id=xa.info_type_id ib.id=xb.info_type_id ka.id=ta.kind_id kb.id=tb.kind_id "
        "ca.id=ma.company_id cb.id=mb.company_id",
        ["lt.link IN ('follows', 'followed by')", "xb.info < '7'", "ta.production_year < tb.production_year", "ca.country_code = '[us]' OR cb.country_code = '[gb]'"],
        {"first_company": "ca.name", "second_company": "cb.name", "first_rating": "xa.info", "second_rating": "xb.info", "first_title": "ta.title", "second_title": "tb.title"},
    ),
}


def parts(name: str) -> tuple[dict[str, str], list[str], dict[str, str]]:
    """Tables by alias, predicates, and outputs."""
    tables, edges, filters, outputs = QUERIES[name]
    equal = [f"{a} = {b}" for group in edges.split() for sides in [group.split("=")] for i, a in enumerate(sides) for b in sides[i + 1 :]]
    return dict(t.split() for t in tables.split(", ")), equal + filters, outputs


def movie_sql(name: str) -> str:
    tables, predicates, outputs = parts(name)
    views = ", ".join(f"{t} AS ({view_sql(t)})" for t in sorted(set(tables.values())))
    chosen = ", ".join(f"MIN({e}) AS {n}" for n, e in outputs.items())
    return f"WITH {views} SELECT {chosen} FROM {', '.join(f'{t} AS {a}' for a, t in tables.items())} WHERE {' AND '.join(f'({p})' for p in predicates)}"


def joined(inputs: Mapping[str, DataFrame], name: str, **options) -> DataFrame:
    """A query over given inputs; ``options`` are those of ``multiway_min``."""
    _, predicates, outputs = parts(name)
    return multiway_min(inputs, predicates, outputs, **options)


def _plan(name: str) -> Callable[[Database], DataFrame]:
    def plan(db: Database) -> DataFrame:
        movies = MovieDatabase(db.spark, db.dir)
        return joined({a: movies[t] for a, t in parts(name)[0].items()}, name)

    return plan


PLANS = {name: _plan(name) for name in QUERIES}
SQL = {name: movie_sql(name) for name in QUERIES}
