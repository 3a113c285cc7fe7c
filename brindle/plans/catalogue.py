"""One query for each operator and expression, with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle import functions as E
from brindle.operators import (
    aggregate, cross_product, group_by_aggregate, hash_join, multiway_join, numbered, order_by, output, project, ranked, scalar_cross, scan, scan_select, select, vector_select,
)
from brindle.plans.inspect import scans
from brindle.plans.job import star, star_by_sql, star_sql
from brindle.scratch import shared_path
from brindle.sources import read_columnar, read_delimited, write_columnar, write_delimited
from brindle.tables import Database

Plan = Callable[[Database], DataFrame]
PLANS: dict[str, Plan] = {}
SQL: dict[str, str] = {}


def query(sql: str) -> Callable[[Plan], Plan]:
    """Registers a plan under its name with the SQL of the same result."""

    def add(f: Plan) -> Plan:
        PLANS[f.__name__], SQL[f.__name__] = f, sql
        return f

    return add


# Scans, projections, sink


@query("SELECT o_orderkey, o_custkey FROM orders")
def scan_columns(db: Database) -> DataFrame:
    return scan(db["orders"], ["o_orderkey", "o_custkey"])


@query("SELECT l_orderkey, l_extendedprice FROM lineitem WHERE l_quantity < 10 AND l_discount >= 0.05 AND l_returnflag = 'R'")
def scan_select_conjunction(db: Database) -> DataFrame:
    tests = [E.lt("l_quantity", E.lit(10)), E.geq("l_discount", E.lit(0.05)), E.eq("l_returnflag", E.lit("R"))]
    return scan_select(db["lineitem"], ["l_orderkey", "l_extendedprice"], tests)


@query("SELECT p_partkey, p_size FROM part WHERE p_size >= 10 AND p_size < 20 AND p_brand = 'Brand#11'")
def vector_select_conjunction(db: Database) -> DataFrame:
    return vector_select(db["part"], ["p_partkey", "p_size"], {"p_size": [(">=", 10), ("<", 20)], "p_brand": [("=", "Brand#11")]})


@query("SELECT p_partkey, p_size FROM part WHERE p_size <= 3 OR p_size > 47 OR p_brand = 'Brand#11' OR p_partkey = 5")
def vector_select_disjunction(db: Database) -> DataFrame:
    return vector_select(db["part"], ["p_partkey", "p_size"], {"p_size": [("<=", 3), (">", 47)], "p_brand": [("=", "Brand#11")], "p_partkey": [("=", 5)]}, conjunction=False)


@query("SELECT s_suppkey AS supplier, s_acctbal * 2 AS doubled, s_acctbal - 1 AS less, s_name FROM supplier")
def project_renamed(db: Database) -> DataFrame:
    bal = E.col_ref("s_acctbal")
    return project(db["supplier"], {"supplier": "s_suppkey", "doubled": E.mul(bal, E.lit(2)), "less": E.sub(bal, E.lit(1)), "s_name": "s_name"})


@query(
    "SELECT concat(n_nationkey, '|', n_name, '|', CASE WHEN n_regionkey = 1 THEN 't' ELSE 'f' END, '|', printf('%.6f', n_regionkey / 4.0), '|', '|', '1996-02-03|') AS line FROM nation"
)
def output_text(db: Database) -> DataFrame:
    region = E.col_ref("n_regionkey")
    values = {"k": "n_nationkey", "n": "n_name", "b": E.eq(region, E.lit(1)), "d": E.float_(region) / 4, "x": E.null("int"), "at": E.date(1996, 2, 3)}
    return output(project(db["nation"], values))


@query("SELECT n_nationkey, nullif(n_name, 'NATION_3') AS n_name, CAST(NULL AS VARCHAR) AS n_comment FROM nation")
def delimited_round_trip(db: Database) -> DataFrame:
    """Text with NULL fields, written and read again in a schema of the reader's."""
    path = shared_path(db.spark, "delimited")
    name = F.nullif("n_name", F.lit("NATION_3"))
    write_delimited(project(db["nation"], {"n_nationkey": "n_nationkey", "n_name": name, "n_regionkey": "n_regionkey", "n_comment": E.null("string")}), path)
    return scan(read_delimited(db.spark, path, "nation"), ["n_nationkey", "n_name", "n_comment"])


@query("SELECT p_partkey, concat('\"', p_name, '|\\', p_type) AS odd, CASE WHEN p_size < 25 THEN '' END AS blank, p_size, p_retailprice, p_size > 9 AS big FROM part")
def delimited_escapes(db: Database) -> DataFrame:
    """Quotes, separators, backslashes, empty and NULL text, and other types, written and read again."""
    odd, blank = F.concat(F.lit('"'), "p_name", F.lit("|\\"), "p_type"), F.when(F.col("p_size") < 25, "")
    path, size = shared_path(db.spark, "escapes"), E.col_ref("p_size")
    write_delimited(project(db["part"], {"p_partkey": "p_partkey", "odd": odd, "blank": blank, "p_size": size, "p_retailprice": "p_retailprice", "big": E.gt(size, E.lit(9))}), path)
    return read_delimited(db.spark, path, "p_partkey long, odd string, blank string, p_size int, p_retailprice double, big boolean")


def _columnar_orders(db: Database) -> DataFrame:
    """Orders written, sorted by date, and read again."""
    path = shared_path(db.spark, "columnar")
    write_columnar(scan(db["orders"], ["o_orderkey", "o_orderpriority", "o_orderdate"]), path, sort_by=["o_orderdate"])
    return read_columnar(db.spark, path)


@query("SELECT o_orderkey, o_orderpriority, CAST(o_orderdate AS DATE) AS o_orderdate FROM orders")
def columnar_round_trip(db: Database) -> DataFrame:
    return _columnar_orders(db)


@query("SELECT o_orderkey, o_orderpriority, CAST(o_orderdate AS DATE) AS o_orderdate FROM orders WHERE o_orderdate >= DATE '2000-01-01'")
def columnar_round_trip_pushed(db: Database) -> DataFrame:
    """A share of the rows that does not fall with the table's size, by a filter that the files are read with."""
    return select(_columnar_orders(db), E.geq("o_orderdate", E.date(2000, 1, 1)))


# Filters by type and predicate


@query("SELECT n_nationkey FROM nation WHERE n_nationkey > 9 AND n_nationkey <> 12")
def filter_int(db: Database) -> DataFrame:
    key = E.col_ref("n_nationkey")
    return select(db["nation"], E.and_(E.gt(key, E.lit(9)), E.neq(key, E.lit(12)))).select("n_nationkey")


@query("SELECT o_orderkey FROM orders WHERE o_orderkey >= 14000")
def filter_bigint(db: Database) -> DataFrame:
    return select(db["orders"], E.geq("o_orderkey", E.lit(14000))).select("o_orderkey")


@query("SELECT c_custkey FROM customer WHERE c_acctbal > -0.5 AND c_acctbal <= 5000.25")
def filter_double(db: Database) -> DataFrame:
    return select(db["customer"], E.and_(E.gt("c_acctbal", E.lit(-0.5)), E.leq("c_acctbal", E.lit(5000.25)))).select("c_custkey")


@query("SELECT o_orderkey FROM orders WHERE o_orderdate >= DATE '2000-01-01'")
def filter_date(db: Database) -> DataFrame:
    return select(db["orders"], E.geq("o_orderdate", E.date(2000, 1, 1))).select("o_orderkey")


@query("SELECT p_partkey, p_type FROM part WHERE p_type > 'M' AND p_type <> 'PROMO'")
def filter_string(db: Database) -> DataFrame:
    return select(db["part"], E.and_(E.gt("p_type", E.lit("M")), E.neq("p_type", E.lit("PROMO")))).select("p_partkey", "p_type")


@query("SELECT o_orderkey FROM orders WHERE (o_totalprice > 1000) = true AND NOT (o_orderstatus = 'F')")
def filter_boolean(db: Database) -> DataFrame:
    return select(db["orders"], E.and_(E.eq(E.gt("o_totalprice", E.lit(1000)), E.lit(True)), E.not_(E.eq("o_orderstatus", E.lit("F"))))).select("o_orderkey")


@query("SELECT p_partkey FROM part WHERE CAST(p_size AS SMALLINT) >= 10 AND CAST(p_size AS SMALLINT) <> 12")
def filter_smallint(db: Database) -> DataFrame:
    parts = project(db["part"], {"p_partkey": "p_partkey", "size": F.col("p_size").cast("smallint")})
    return select(parts, E.and_(E.geq("size", E.lit(10)), E.neq("size", E.lit(12)))).select("p_partkey")


@query("SELECT o_orderkey FROM orders WHERE o_totalprice > 100000")
def filter_stored_boolean(db: Database) -> DataFrame:
    """A column of booleans in a file, not a comparison that is computed."""
    path = shared_path(db.spark, "booleans")
    write_columnar(project(db["orders"], {"o_orderkey": "o_orderkey", "big": E.gt("o_totalprice", E.lit(100000))}), path)
    return select(read_columnar(db.spark, path), E.eq("big", E.lit(True))).select("o_orderkey")


@query("SELECT c_custkey FROM customer WHERE (c_nationkey = 3 OR c_nationkey = 4) AND NOT (c_acctbal < 0 OR c_mktsegment = 'BUILDING')")
def filter_and_or_not(db: Database) -> DataFrame:
    nation = E.or_(E.eq("c_nationkey", E.lit(3)), E.eq("c_nationkey", E.lit(4)))
    return select(db["customer"], E.and_(nation, E.not_(E.or_(E.lt("c_acctbal", E.lit(0)), E.eq("c_mktsegment", E.lit("BUILDING")))))).select("c_custkey")


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity BETWEEN 3 AND 5 AND l_discount NOT BETWEEN 0.02 AND 0.08")
def filter_between(db: Database) -> DataFrame:
    both = E.and_(E.between("l_quantity", E.lit(3), E.lit(5)), E.not_(E.between("l_discount", E.lit(0.02), E.lit(0.08))))
    return select(db["lineitem"], both).select("l_orderkey", "l_linenumber")


@query("SELECT p_partkey FROM part WHERE p_size IN (1, 7, 49) AND p_brand NOT IN ('Brand#11', 'Brand#12')")
def filter_in(db: Database) -> DataFrame:
    return select(db["part"], E.and_(E.in_("p_size", 1, 7, 49), E.not_(E.in_("p_brand", "Brand#11", "Brand#12")))).select("p_partkey")


@query("SELECT p_partkey FROM part WHERE p_type IN ('NO SUCH TYPE')")
def filter_in_unknown(db: Database) -> DataFrame:
    return select(db["part"], E.in_("p_type", "NO SUCH TYPE")).select("p_partkey")


@query("SELECT p_partkey, p_name FROM part WHERE p_name LIKE 'small%' OR p_name LIKE '%ring' OR p_name LIKE '%d_e%'")
def filter_like(db: Database) -> DataFrame:
    return select(db["part"], E.or_(E.like("p_name", "small%"), E.like("p_name", "%ring"), E.like("p_name", "%d_e%"))).select("p_partkey", "p_name")


@query("SELECT p_partkey, p_name FROM part WHERE p_name NOT LIKE '%e%'")
def filter_not_like(db: Database) -> DataFrame:
    return select(db["part"], E.not_(E.like("p_name", "%e%"))).select("p_partkey", "p_name")


@query("SELECT p_partkey FROM part WHERE starts_with(p_name, 'blue') OR ends_with(p_name, 'bolt') OR contains(p_name, ' wi')")
def filter_string_parts(db: Database) -> DataFrame:
    return select(db["part"], E.or_(E.starts_with("p_name", "blue"), E.ends_with("p_name", "bolt"), E.contains("p_name", " wi"))).select("p_partkey")


@query("SELECT p_partkey, p_name FROM part WHERE regexp_full_match(p_name, '(small|large) [a-z]*g.*')")
def filter_regex(db: Database) -> DataFrame:
    return select(db["part"], E.matches("p_name", "(small|large) [a-z]*g.*")).select("p_partkey", "p_name")


NULLED = "SELECT c_custkey, nullif(c_mktsegment, 'BUILDING') AS seg, CASE WHEN c_acctbal > 0 THEN c_acctbal END AS bal FROM customer"


def _nulled(db: Database) -> DataFrame:
    """Customers with NULLs in two columns."""
    return project(db["customer"], {"c_custkey": "c_custkey", "seg": F.nullif("c_mktsegment", F.lit("BUILDING")), "bal": F.when(F.col("c_acctbal") > 0, F.col("c_acctbal"))})


@query(f"SELECT c_custkey FROM ({NULLED}) t WHERE seg IS NULL OR bal IS NOT NULL AND NOT (seg LIKE 'A%')")
def filter_null(db: Database) -> DataFrame:
    return select(_nulled(db), E.or_(E.is_null("seg"), E.and_(E.is_not_null("bal"), E.not_(E.like("seg", "A%"))))).select("c_custkey")


@query(f"SELECT c_custkey FROM ({NULLED}) t WHERE NOT coalesce(regexp_full_match(seg, 'A.*'), false)")
def filter_regex_null_as_false(db: Database) -> DataFrame:
    return select(_nulled(db), E.not_(E.matches_or_false("seg", "A.*"))).select("c_custkey")


# Expressions


@query(
    """SELECT l_orderkey, l_linenumber, l_linenumber + 1 AS plus, l_linenumber * 3 - 2 AS mixed, round(l_extendedprice / l_quantity, 8) AS unit,
    CASE WHEN l_discount = 0 THEN NULL ELSE round(l_tax / l_discount, 8) END AS ratio, CAST(l_linenumber AS DOUBLE) AS line FROM lineitem"""
)
def arithmetic(db: Database) -> DataFrame:
    n = E.col_ref("l_linenumber")
    return project(
        db["lineitem"],
        {
            "l_orderkey": "l_orderkey", "l_linenumber": n, "plus": E.add(n, E.lit(1)), "mixed": E.sub(E.mul(n, E.lit(3)), E.lit(2)),
            "unit": F.round(E.div("l_extendedprice", "l_quantity"), 8), "ratio": F.round(E.safe_div("l_tax", "l_discount"), 8), "line": E.float_(n),
        },
    )


@query("SELECT o_orderkey, CAST(extract(year FROM o_orderdate) AS INTEGER) AS y FROM orders")
def extract_year(db: Database) -> DataFrame:
    return project(db["orders"], {"o_orderkey": "o_orderkey", "y": E.extract_year("o_orderdate")})


@query("SELECT p_partkey, CASE WHEN p_size < 10 THEN 'small' ELSE CASE WHEN p_size < 30 THEN 'medium' ELSE 'large' END END AS class FROM part")
def case_nested(db: Database) -> DataFrame:
    inner = E.case(E.lt("p_size", E.lit(30)), E.lit("medium"), E.lit("large"))
    return project(db["part"], {"p_partkey": "p_partkey", "class": E.case(E.lt("p_size", E.lit(10)), E.lit("small"), inner)})


# Joins


@query("SELECT o_orderkey, c_name FROM orders, customer WHERE o_custkey = c_custkey")
def hash_join_one_key(db: Database) -> DataFrame:
    return hash_join(scan(db["orders"], ["o_orderkey", "o_custkey"]), scan(db["customer"], ["c_custkey", "c_name"]), [("o_custkey", "c_custkey")]).select("o_orderkey", "c_name")


@query("SELECT c_custkey, s_suppkey FROM customer, supplier WHERE c_nationkey = s_nationkey AND c_custkey = s_suppkey")
def hash_join_two_keys(db: Database) -> DataFrame:
    left, right = scan(db["customer"], ["c_custkey", "c_nationkey"]), scan(db["supplier"], ["s_suppkey", "s_nationkey"])
    return hash_join(left, right, [("c_nationkey", "s_nationkey"), ("c_custkey", "s_suppkey")], "broadcast").select("c_custkey", "s_suppkey")


@query("SELECT o_orderkey, l_linenumber FROM orders, lineitem WHERE o_orderkey = l_orderkey AND o_orderdate = l_shipdate")
def hash_join_date(db: Database) -> DataFrame:
    left, right = scan(db["orders"], ["o_orderkey", "o_orderdate"]), scan(db["lineitem"], ["l_orderkey", "l_linenumber", "l_shipdate"])
    return hash_join(left, right, [("o_orderkey", "l_orderkey"), ("o_orderdate", "l_shipdate")], "shuffle_hash").select("o_orderkey", "l_linenumber")


@query("SELECT a.c_name AS name, b.c_name AS other FROM customer a, customer b WHERE a.c_custkey = b.c_nationkey")
def hash_join_self(db: Database) -> DataFrame:
    """A table with itself on two different columns."""
    c = scan(db["customer"], ["c_custkey", "c_nationkey", "c_name"])
    return hash_join(c.alias("a"), c.alias("b"), [("c_custkey", "c_nationkey")]).select(F.col("a.c_name").alias("name"), F.col("b.c_name").alias("other"))


@query(f"SELECT a.c_custkey AS x, count(*) AS n FROM ({NULLED}) a, ({NULLED}) b WHERE a.seg = b.seg GROUP BY 1")
def join_null_keys(db: Database) -> DataFrame:
    """All customers on both sides; one is counted by key first, so the pairs of a hot key are never rows."""
    sizes = group_by_aggregate(_nulled(db), {"seg": "seg"}, {"m": E.count()})
    j = multiway_join({"a": _nulled(db), "b": sizes}, ["a.seg = b.seg"])
    return group_by_aggregate(j, {"x": F.col("a.c_custkey")}, {"n": F.sum("b.m")})


@query("SELECT n1.n_name AS a, n2.n_name AS b FROM nation n1, nation n2 WHERE n1.n_regionkey = n2.n_regionkey AND n1.n_nationkey < n2.n_nationkey")
def self_join(db: Database) -> DataFrame:
    j = multiway_join({"n1": db["nation"], "n2": db["nation"]}, ["n1.n_regionkey = n2.n_regionkey", "n1.n_nationkey < n2.n_nationkey"])
    return j.select(F.col("n1.n_name").alias("a"), F.col("n2.n_name").alias("b"))


@query("SELECT n_name, r_name FROM nation, region WHERE n_nationkey > 20 * r_regionkey OR (n_name = 'NATION_1' AND r_name = 'ASIA')")
def theta_join(db: Database) -> DataFrame:
    j = multiway_join({"n": db["nation"], "r": db["region"]}, ["n.n_nationkey > 20 * r.r_regionkey OR (n.n_name = 'NATION_1' AND r.r_name = 'ASIA')"])
    return j.select("n_name", "r_name")


@query(
    """SELECT a.s_suppkey AS k1, d.s_suppkey AS k4, a.s_name FROM supplier a, supplier b, supplier c, supplier d
    WHERE a.s_suppkey = b.s_suppkey AND b.s_suppkey = c.s_suppkey AND c.s_suppkey = d.s_suppkey AND a.s_acctbal > 0"""
)
def multiway_self_join(db: Database) -> DataFrame:
    s = db["supplier"]
    preds = ["a.s_suppkey = b.s_suppkey", "b.s_suppkey = c.s_suppkey", "c.s_suppkey = d.s_suppkey", "a.s_acctbal > 0"]
    j = multiway_join({"a": s, "b": s, "c": s, "d": s}, preds, prefix=("d", "c"))
    return j.select(F.col("a.s_suppkey").alias("k1"), F.col("d.s_suppkey").alias("k4"), F.col("a.s_name").alias("s_name"))


@query("SELECT n_name, r_name FROM nation, region")
def cross_product_pairs(db: Database) -> DataFrame:
    return cross_product(scan(db["nation"], ["n_name"]), scan(db["region"], ["r_name"]))


@query("SELECT c_custkey FROM customer WHERE c_acctbal > (SELECT 1.5 * avg(c_acctbal) FROM customer)")
def scalar_subquery(db: Database) -> DataFrame:
    mean = aggregate(db["customer"], {"mean": 1.5 * E.avg("c_acctbal")})
    return select(scalar_cross(scan(db["customer"], ["c_custkey", "c_acctbal"]), mean), F.col("c_acctbal") > F.col("mean")).select("c_custkey")


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders GROUP BY o_custkey HAVING count(*) >= 15)")
def in_subquery(db: Database) -> DataFrame:
    busy = group_by_aggregate(db["orders"], {"k": "o_custkey"}, {"n": E.count()}, F.col("n") >= 15)
    return hash_join(scan(db["customer"], ["c_custkey", "c_name"]), busy, [("c_custkey", "k")]).select("c_custkey", "c_name")


@query("SELECT s_nationkey, s_name FROM supplier a WHERE s_acctbal = (SELECT min(s_acctbal) FROM supplier b WHERE b.s_nationkey = a.s_nationkey)")
def correlated_min(db: Database) -> DataFrame:
    least = group_by_aggregate(db["supplier"], {"nk": "s_nationkey"}, {"bal": E.min_("s_acctbal")})
    return hash_join(db["supplier"], least, [("s_nationkey", "nk"), ("s_acctbal", "bal")]).select("s_nationkey", "s_name")


# Aggregation


FIVE = "CAST(sum({0}) AS BIGINT) AS s, round(avg({0}), 4) AS a, count({0}) AS c, max({0}) AS hi, min({0}) AS lo, count(*) AS n"


def _five(c: str, **more) -> dict:
    return {"s": E.sum_(c), "a": F.round(E.avg(c), 4), "c": E.count(c), "hi": E.max_(c), "lo": E.min_(c), "n": E.count()} | more


@query(f"SELECT {FIVE.format('p_size')} FROM part")
def aggregate_int(db: Database) -> DataFrame:
    return aggregate(db["part"], _five("p_size"))


@query("SELECT min(o_orderdate)::DATE::VARCHAR AS first, max(o_orderdate)::DATE::VARCHAR AS last, min(o_orderpriority) AS low, max(o_orderstatus) AS high, round(sum(o_totalprice), 2) AS total FROM orders")
def aggregate_date_string_double(db: Database) -> DataFrame:
    return aggregate(
        db["orders"],
        {
            "first": E.min_("o_orderdate").cast("string"), "last": E.max_("o_orderdate").cast("string"), "low": E.min_("o_orderpriority"),
            "high": E.max_("o_orderstatus"), "total": F.round(E.sum_("o_totalprice"), 2),
        },
    )


@query(f"SELECT {FIVE.format('p_size')} FROM part WHERE false")
def aggregate_empty(db: Database) -> DataFrame:
    return aggregate(select(db["part"], F.lit(False)), _five("p_size"))


@query("SELECT CASE WHEN count(*) > 0 THEN count(p_size) END AS c, CASE WHEN count(*) > 0 THEN count(*) END AS n FROM part WHERE p_size < 0")
def aggregate_empty_as_null(db: Database) -> DataFrame:
    return aggregate(select(db["part"], F.col("p_size") < 0), {"c": E.count_or_null("p_size"), "n": E.count_or_null()})


@query(f"SELECT seg, count(*) AS n, count(bal) AS c, round(sum(bal), 2) AS s, max(seg) AS m FROM ({NULLED}) t GROUP BY seg")
def group_by_null(db: Database) -> DataFrame:
    return group_by_aggregate(_nulled(db), {"seg": "seg"}, {"n": E.count(), "c": E.count("bal"), "s": F.round(E.sum_("bal"), 2), "m": E.max_("seg")})


@query(f"SELECT CAST(extract(year FROM o_orderdate) AS INTEGER) AS y, o_totalprice > 100000 AS big, {FIVE.format('o_orderkey')} FROM orders GROUP BY 1, 2")
def group_by_derived(db: Database) -> DataFrame:
    return group_by_aggregate(db["orders"], {"y": E.extract_year("o_orderdate"), "big": E.gt("o_totalprice", E.lit(100000))}, _five("o_orderkey"))


@query("SELECT o_orderpriority, count(*) AS n FROM orders WHERE o_orderkey < 0 GROUP BY 1")
def group_by_no_rows(db: Database) -> DataFrame:
    return group_by_aggregate(select(db["orders"], F.col("o_orderkey") < 0), {"o_orderpriority": "o_orderpriority"}, {"n": E.count()})


@query(
    """SELECT l_returnflag, CAST(sum(CASE WHEN l_quantity > 25 THEN 1 ELSE 0 END) AS BIGINT) AS many,
    round(100 * sum(CASE WHEN l_discount > 0.05 THEN l_extendedprice ELSE 0 END) / sum(l_extendedprice), 4) AS share FROM lineitem GROUP BY 1"""
)
def aggregate_conditional(db: Database) -> DataFrame:
    many = E.sum_(E.case(E.gt("l_quantity", E.lit(25)), E.lit(1), E.lit(0)))
    share = 100 * E.sum_(E.case(E.gt("l_discount", E.lit(0.05)), "l_extendedprice", E.lit(0.0))) / E.sum_("l_extendedprice")
    return group_by_aggregate(db["lineitem"], {"l_returnflag": "l_returnflag"}, {"many": many, "share": F.round(share, 4)})


@query("SELECT l_suppkey, count(*) AS n, round(sum(l_quantity), 2) AS q FROM lineitem GROUP BY 1 HAVING count(*) > 600 AND sum(l_quantity) > 15000")
def group_by_having(db: Database) -> DataFrame:
    having = E.and_(E.gt("n", E.lit(600)), E.gt("q", E.lit(15000)))
    return group_by_aggregate(db["lineitem"], {"l_suppkey": "l_suppkey"}, {"n": E.count(), "q": F.round(E.sum_("l_quantity"), 2)}, having)


# Order


@query(f"SELECT seg, row_number() OVER (ORDER BY seg ASC NULLS LAST) AS up, row_number() OVER (ORDER BY seg DESC NULLS FIRST) AS down FROM (SELECT DISTINCT seg FROM ({NULLED}) t) u")
def order_null_largest(db: Database) -> DataFrame:
    """Places in either order of the few distinct segments."""
    segs = group_by_aggregate(_nulled(db), {"seg": "seg"}, {})
    up, down = (numbered(order_by(segs, [("seg", asc)]), "n") for asc in (True, False))
    return up.alias("up").join(down.alias("down"), F.col("up.seg").eqNullSafe(F.col("down.seg"))).select("up.seg", F.col("up.n").alias("up"), F.col("down.n").alias("down"))


@query("SELECT s_nationkey, s_acctbal, s_name, row_number() OVER (ORDER BY s_nationkey, s_acctbal DESC, s_name) AS place FROM supplier")
def order_by_many(db: Database) -> DataFrame:
    return numbered(order_by(db["supplier"].select("s_nationkey", "s_acctbal", "s_name"), [("s_nationkey", True), ("s_acctbal", False), ("s_name", True)]), "place")


@query(
    """SELECT o_orderkey, row_number() OVER (ORDER BY big DESC NULLS FIRST, day, price DESC NULLS FIRST, o_orderkey) AS place FROM (SELECT o_orderkey, CASE WHEN o_custkey % 5 > 0 THEN o_totalprice > 100000 END AS big,
    CAST(o_orderdate AS DATE) AS day, CASE WHEN o_custkey % 3 > 0 THEN o_totalprice END AS price FROM orders) t"""
)
def order_by_types(db: Database) -> DataFrame:
    """Booleans and doubles with NULLs, descending, dates and longs ascending."""
    big, price = F.when(F.col("o_custkey") % 5 > 0, F.col("o_totalprice") > 100000), F.when(F.col("o_custkey") % 3 > 0, F.col("o_totalprice"))
    rows = project(db["orders"], {"o_orderkey": "o_orderkey", "big": big, "day": "o_orderdate", "price": price})
    return numbered(order_by(rows, [("big", False), ("day", True), ("price", False), ("o_orderkey", True)]), "place").select("o_orderkey", "place")


@query("SELECT c_mktsegment, c_custkey, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal DESC, c_custkey) AS place FROM customer")
def order_in_groups(db: Database) -> DataFrame:
    """Places in the few large groups, each of which is sorted by many tasks."""
    return ranked(db["customer"], ["c_mktsegment"], [F.col("c_acctbal").desc(), F.col("c_custkey")], "place").select("c_mktsegment", "c_custkey", "place")


# Plan inspection


@query("SELECT unnest(['l_orderkey', 'l_quantity', 'l_returnflag']) AS read_column, 3 AS filters, 1 AS scans")
def inspect_plan(db: Database) -> DataFrame:
    """What a filtered scan of three columns reads, and that its filters (two, and one that the column is there) are pushed."""
    df = scan_select(db["lineitem"], ["l_orderkey"], [E.lt("l_quantity", E.lit(10)), E.eq("l_returnflag", E.lit("R"))])
    found = scans(df)
    ((columns, filters),) = found
    kept = [f for f in filters if "IsNotNull" not in f] + [f for f in filters if f == "IsNotNull(l_quantity)"]
    return db.spark.createDataFrame([(c, len(kept), len(found)) for c in columns], "read_column string, filters int, scans int")


# SQL entry


@query(star_sql("job_six_tables_cycle"))
def sql_entry(db: Database) -> DataFrame:
    return star_by_sql(db, "job_six_tables_cycle")


def _by_strategy(strategy: str | None) -> Plan:
    return lambda db: star(db, "job_five_tables_or", strategy=strategy, measure=strategy is None)


for _name, _strategy in {"merge": "merge", "shuffle_hash": "shuffle_hash", "broadcast": "broadcast", "measured": None}.items():
    PLANS[f"strategy_{_name}"], SQL[f"strategy_{_name}"] = _by_strategy(_strategy), star_sql("job_five_tables_or")
