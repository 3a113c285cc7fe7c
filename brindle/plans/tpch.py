"""Fourteen decision-support plans on the star schema, and eight more shapes.

Each is a DataFrame plan (``PLANS``) with its SQL (``SQL``). Constants suit the tables at hand; where the schema
lacks a column of the benchmark, the nearest measure stands in, as the SQL shows. Sums of doubles are rounded where
no exact value can be a tie, and dates are shown as text, so that other engines give equal values.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brindle.functions import and_, case, contains, date, extract_year, or_, starts_with
from brindle.operators import aggregate, group_by_aggregate, hash_join, multiway_join, order_by, scalar_cross, scan, scan_select, select
from brindle.tables import KEYS, Database

MONEY = "l_extendedprice * (1 - l_discount)"


def revenue() -> Column:
    return F.col("l_extendedprice") * (1 - F.col("l_discount"))


def cents(c: Column) -> Column:
    return F.round(c, 2)


def q01(db: Database) -> DataFrame:
    lines = scan_select(
        db["lineitem"],
        ["l_returnflag", "l_linestatus", "l_quantity", "l_extendedprice", "l_discount", "l_tax"],
        [F.col("l_shipdate") <= date(2001, 9, 1)],
    )
    out = group_by_aggregate(
        lines,
        {"l_returnflag": "l_returnflag", "l_linestatus": "l_linestatus"},
        {
            "sum_qty": cents(F.sum("l_quantity")),
            "sum_base_price": cents(F.sum("l_extendedprice")),
            "sum_disc_price": F.round(F.sum(revenue()), 4),
            "sum_charge": cents(F.sum(revenue() * (1 + F.col("l_tax")))),
            "avg_qty": cents(F.avg("l_quantity")),
            "avg_price": cents(F.avg("l_extendedprice")),
            "avg_disc": F.round(F.avg("l_discount"), 4),
            "count_order": F.count(F.lit(1)),
        },
    )
    return order_by(out, [("l_returnflag", True), ("l_linestatus", True)])


def _regional(db: Database, region: str) -> DataFrame:
    """Suppliers of a region, with the nation's name."""
    return multiway_join(
        {"s": scan(db["supplier"], ["s_suppkey", "s_name", "s_acctbal", "s_nationkey"]), "n": db["nation"], "r": db["region"]},
        ["s.s_nationkey = n.n_nationkey", "n.n_regionkey = r.r_regionkey", f"r.r_name = '{region}'"],
    ).select("s_suppkey", "s_name", "s_acctbal", "n_name")


def q02(db: Database) -> DataFrame:
    """A tree of hash joins: regional offers, the least offer for each part, and the part."""
    offers = hash_join(scan(db["lineitem"], ["l_partkey", "l_suppkey", "l_extendedprice"]), _regional(db, "MIDDLE EAST"), [("l_suppkey", "s_suppkey")])
    least = group_by_aggregate(offers, {"m_partkey": "l_partkey"}, {"m_price": F.min("l_extendedprice")})
    best = hash_join(offers, least, [("l_partkey", "m_partkey"), ("l_extendedprice", "m_price")])
    named = hash_join(best, scan(db["part"], ["p_partkey", "p_name"]), [("l_partkey", "p_partkey")])
    out = named.select("s_acctbal", "s_name", "n_name", "p_partkey", "p_name", F.col("m_price").alias("price"))
    return order_by(out, [("s_acctbal", False), ("n_name", True), ("s_name", True), ("p_partkey", True)])


def q03(db: Database) -> DataFrame:
    j = multiway_join(
        {
            "c": scan(db["customer"], ["c_custkey", "c_mktsegment"]),
            "o": scan(db["orders"], ["o_orderkey", "o_custkey", "o_orderdate"]),
            "l": scan(db["lineitem"], ["l_orderkey", "l_extendedprice", "l_discount", "l_shipdate"]),
        },
        [
            "c.c_mktsegment = 'AUTOMOBILE'", "c.c_custkey = o.o_custkey", "l.l_orderkey = o.o_orderkey",
            "o.o_orderdate < DATE '1998-03-30'", "l.l_shipdate > DATE '1998-03-30'",
        ],
    )
    out = group_by_aggregate(j, {"l_orderkey": "l_orderkey", "o_orderdate": F.col("o_orderdate").cast("string")}, {"revenue": F.round(F.sum(revenue()), 4)})
    return order_by(out, [("revenue", False), ("o_orderdate", True)])


def q05(db: Database) -> DataFrame:
    j = multiway_join(
        {
            "c": scan(db["customer"], ["c_custkey", "c_nationkey"]),
            "o": scan(db["orders"], ["o_orderkey", "o_custkey", "o_orderdate"]),
            "l": scan(db["lineitem"], ["l_orderkey", "l_suppkey", "l_extendedprice", "l_discount"]),
            "s": scan(db["supplier"], ["s_suppkey", "s_nationkey"]),
            "n": db["nation"],
            "r": db["region"],
        },
        [
            "c.c_custkey = o.o_custkey", "l.l_orderkey = o.o_orderkey", "l.l_suppkey = s.s_suppkey", "c.c_nationkey = s.s_nationkey",
            "s.s_nationkey = n.n_nationkey", "n.n_regionkey = r.r_regionkey", "r.r_name = 'MIDDLE EAST'",
            "o.o_orderdate >= DATE '1996-01-01' AND o.o_orderdate < DATE '1997-01-01'",
        ],
    )
    return order_by(group_by_aggregate(j, {"n_name": "n_name"}, {"revenue": F.round(F.sum(revenue()), 4)}), [("revenue", False)])


def q06(db: Database) -> DataFrame:
    lines = scan_select(
        db["lineitem"],
        ["l_extendedprice", "l_discount"],
        [
            F.col("l_shipdate") >= date(1996, 1, 1), F.col("l_shipdate") < date(1997, 1, 1),
            F.col("l_discount").between(0.02, 0.04), F.col("l_quantity") < 25,
        ],
    )
    return aggregate(lines, {"revenue": F.round(F.sum(F.col("l_extendedprice") * F.col("l_discount")), 4)})


def q07(db: Database) -> DataFrame:
    nation = scan(db["nation"], ["n_nationkey", "n_name"]).filter(F.col("n_name").isin("NATION_1", "NATION_2"))
    j = multiway_join(
        {
            "s": scan(db["supplier"], ["s_suppkey", "s_nationkey"]),
            "l": scan(db["lineitem"], ["l_orderkey", "l_suppkey", "l_extendedprice", "l_discount", "l_shipdate"]),
            "o": scan(db["orders"], ["o_orderkey", "o_custkey"]),
            "c": scan(db["customer"], ["c_custkey", "c_nationkey"]),
            "n1": nation,
            "n2": nation,
        },
        [
            "s.s_suppkey = l.l_suppkey", "o.o_orderkey = l.l_orderkey", "c.c_custkey = o.o_custkey", "s.s_nationkey = n1.n_nationkey",
            "c.c_nationkey = n2.n_nationkey", "l.l_shipdate BETWEEN DATE '1996-01-01' AND DATE '1997-12-31'",
            "(n1.n_name = 'NATION_1' AND n2.n_name = 'NATION_2') OR (n1.n_name = 'NATION_2' AND n2.n_name = 'NATION_1')",
        ],
    )
    keys = {"supp_nation": F.col("n1.n_name"), "cust_nation": F.col("n2.n_name"), "l_year": extract_year("l_shipdate")}
    out = group_by_aggregate(j, keys, {"revenue": F.round(F.sum(revenue()), 4)})
    return order_by(out, [("supp_nation", True), ("cust_nation", True), ("l_year", True)])


def q08(db: Database) -> DataFrame:
    j = multiway_join(
        {
            "p": scan(db["part"], ["p_partkey", "p_type"]),
            "l": scan(db["lineitem"], ["l_orderkey", "l_partkey", "l_suppkey", "l_extendedprice", "l_discount"]),
            "o": scan(db["orders"], ["o_orderkey", "o_custkey", "o_orderdate"]),
            "c": scan(db["customer"], ["c_custkey", "c_nationkey"]),
            "n1": scan(db["nation"], ["n_nationkey", "n_regionkey"]),
            "r": db["region"],
            "s": scan(db["supplier"], ["s_suppkey", "s_nationkey"]),
            "n2": scan(db["nation"], ["n_nationkey", "n_name"]),
        },
        [
            "p.p_partkey = l.l_partkey", "s.s_suppkey = l.l_suppkey", "l.l_orderkey = o.o_orderkey", "o.o_custkey = c.c_custkey",
            "c.c_nationkey = n1.n_nationkey", "n1.n_regionkey = r.r_regionkey", "s.s_nationkey = n2.n_nationkey", "r.r_name = 'AFRICA'",
            "o.o_orderdate BETWEEN DATE '1996-01-01' AND DATE '1997-12-31'", "p.p_type = 'ECONOMY'",
        ],
    )
    mine = F.sum(case(F.col("n2.n_name") == "NATION_1", revenue(), F.lit(0.0)))
    out = group_by_aggregate(j, {"o_year": extract_year("o_orderdate")}, {"mkt_share": F.round(mine / F.sum(revenue()), 4)})
    return order_by(out, [("o_year", True)])


def q09(db: Database) -> DataFrame:
    parts = scan_select(db["part"], ["p_partkey"], [contains("p_name", "widget")])
    j = multiway_join(
        {
            "p": parts,
            "l": scan(db["lineitem"], ["l_orderkey", "l_partkey", "l_suppkey", "l_extendedprice", "l_discount"]),
            "o": scan(db["orders"], ["o_orderkey", "o_orderdate"]),
            "s": scan(db["supplier"], ["s_suppkey", "s_nationkey"]),
            "n": scan(db["nation"], ["n_nationkey", "n_name"]),
        },
        ["p.p_partkey = l.l_partkey", "s.s_suppkey = l.l_suppkey", "l.l_orderkey = o.o_orderkey", "s.s_nationkey = n.n_nationkey"],
    )
    out = group_by_aggregate(j, {"nation": "n_name", "o_year": extract_year("o_orderdate")}, {"sum_profit": F.round(F.sum(revenue()), 4)})
    return order_by(out, [("nation", True), ("o_year", False)])


def q10(db: Database) -> DataFrame:
    j = multiway_join(
        {
            "c": scan(db["customer"], ["c_custkey", "c_name", "c_acctbal", "c_nationkey"]),
            "o": scan(db["orders"], ["o_orderkey", "o_custkey", "o_orderdate"]),
            "l": scan(db["lineitem"], ["l_orderkey", "l_extendedprice", "l_discount", "l_returnflag"]),
            "n": scan(db["nation"], ["n_nationkey", "n_name"]),
        },
        [
            "c.c_custkey = o.o_custkey", "l.l_orderkey = o.o_orderkey", "c.c_nationkey = n.n_nationkey", "l.l_returnflag = 'R'",
            "o.o_orderdate >= DATE '1996-01-01' AND o.o_orderdate < DATE '1996-04-01'",
        ],
    )
    keys = {k: k for k in ("c_custkey", "c_name", "c_acctbal", "n_name")}
    return order_by(group_by_aggregate(j, keys, {"revenue": F.round(F.sum(revenue()), 4)}), [("revenue", False)])


def q11(db: Database) -> DataFrame:
    sold = multiway_join(
        {
            "l": scan(db["lineitem"], ["l_partkey", "l_suppkey", "l_extendedprice"]),
            "s": scan(db["supplier"], ["s_suppkey", "s_nationkey"]),
            "n": scan(db["nation"], ["n_nationkey", "n_name"]),
        },
        ["l.l_suppkey = s.s_suppkey", "s.s_nationkey = n.n_nationkey", "n.n_name = 'NATION_7'"],
    )
    by_part = group_by_aggregate(sold, {"l_partkey": "l_partkey"}, {"value": F.sum("l_extendedprice")})
    floor = aggregate(sold, {"floor": F.sum("l_extendedprice") * 0.001})
    out = select(scalar_cross(by_part, floor), F.col("value") > F.col("floor")).select("l_partkey", cents(F.col("value")).alias("value"))
    return order_by(out, [("value", False)])


def q12(db: Database) -> DataFrame:
    j = multiway_join(
        {"o": scan(db["orders"], ["o_orderkey", "o_orderpriority"]), "l": scan(db["lineitem"], ["l_orderkey", "l_linestatus", "l_shipdate"])},
        ["o.o_orderkey = l.l_orderkey", "l.l_shipdate >= DATE '1996-01-01' AND l.l_shipdate < DATE '1997-01-01'"],
    )
    urgent = F.col("o_orderpriority").isin("1-URGENT", "2-HIGH")
    out = group_by_aggregate(
        j,
        {"l_linestatus": "l_linestatus"},
        {"high_line_count": F.sum(case(urgent, F.lit(1), F.lit(0))), "low_line_count": F.sum(case(urgent, F.lit(0), F.lit(1)))},
    )
    return order_by(out, [("l_linestatus", True)])


def q14(db: Database) -> DataFrame:
    j = multiway_join(
        {"p": scan(db["part"], ["p_partkey", "p_type"]), "l": scan(db["lineitem"], ["l_partkey", "l_extendedprice", "l_discount", "l_shipdate"])},
        ["l.l_partkey = p.p_partkey", "l.l_shipdate >= DATE '1996-12-01' AND l.l_shipdate < DATE '1997-01-01'"],
    )
    promo = F.sum(case(starts_with("p_type", "PROMO"), revenue(), F.lit(0.0)))
    return aggregate(j, {"promo_revenue": F.round(100 * promo / F.sum(revenue()), 4)})


def q18(db: Database) -> DataFrame:
    large = group_by_aggregate(
        scan(db["lineitem"], ["l_orderkey", "l_quantity"]), {"b_orderkey": "l_orderkey"}, {"b_quantity": F.sum("l_quantity")}, F.col("b_quantity") > 250
    )
    j = multiway_join(
        {"b": large, "o": scan(db["orders"], ["o_orderkey", "o_custkey", "o_orderdate", "o_totalprice"]), "c": scan(db["customer"], ["c_custkey", "c_name"])},
        ["b.b_orderkey = o.o_orderkey", "c.c_custkey = o.o_custkey"],
        unique={*KEYS, "b_orderkey"},
    )
    out = j.select("c_name", "c_custkey", "o_orderkey", F.col("o_orderdate").cast("string").alias("o_orderdate"), "o_totalprice", cents(F.col("b_quantity")).alias("sum_quantity"))
    return order_by(out, [("o_totalprice", False), ("o_orderdate", True)])


def q19(db: Database) -> DataFrame:
    """Each table is filtered by what the alternatives have in common before the join; the full condition follows."""
    sides = [("Brand#11", 1, 15, 20), ("Brand#12", 10, 25, 30), ("Brand#13", 20, 35, 40)]
    some = or_(*(and_(F.col("p_brand") == b, F.col("p_size").between(1, size)) for b, _, _, size in sides))
    parts = scan_select(db["part"], ["p_partkey", "p_brand", "p_size"], [some])
    lines = scan_select(db["lineitem"], ["l_partkey", "l_quantity", "l_extendedprice", "l_discount"], [or_(*(F.col("l_quantity").between(lo, hi) for _, lo, hi, _ in sides))])
    j = multiway_join({"p": parts, "l": lines}, ["p.p_partkey = l.l_partkey"])
    both = or_(*(and_(F.col("p_brand") == b, F.col("l_quantity").between(lo, hi), F.col("p_size").between(1, size)) for b, lo, hi, size in sides))
    return aggregate(select(j, both), {"revenue": F.round(F.sum(revenue()), 4)})


SQL = {
    "q01": f"""SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_base_price,
        round(sum({MONEY}), 4) AS sum_disc_price, round(sum({MONEY} * (1 + l_tax)), 2) AS sum_charge, round(avg(l_quantity), 2) AS avg_qty,
        round(avg(l_extendedprice), 2) AS avg_price, round(avg(l_discount), 4) AS avg_disc, count(*) AS count_order
        FROM lineitem WHERE l_shipdate <= DATE '2001-09-01' GROUP BY 1, 2""",
    "q02": """WITH o AS (SELECT l_partkey, l_extendedprice, s_acctbal, s_name, n_name FROM lineitem, supplier, nation, region
        WHERE l_suppkey = s_suppkey AND s_nationkey = n_nationkey AND n_regionkey = r_regionkey AND r_name = 'MIDDLE EAST')
        SELECT s_acctbal, s_name, n_name, p_partkey, p_name, l_extendedprice AS price FROM o a, part
        WHERE p_partkey = l_partkey AND l_extendedprice = (SELECT min(l_extendedprice) FROM o b WHERE b.l_partkey = a.l_partkey)""",
    "q03": f"""SELECT l_orderkey, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS o_orderdate, round(sum({MONEY}), 4) AS revenue FROM customer, orders, lineitem
        WHERE c_mktsegment = 'AUTOMOBILE' AND c_custkey = o_custkey AND l_orderkey = o_orderkey AND o_orderdate < DATE '1998-03-30'
        AND l_shipdate > DATE '1998-03-30' GROUP BY 1, 2""",
    "q05": f"""SELECT n_name, round(sum({MONEY}), 4) AS revenue FROM customer, orders, lineitem, supplier, nation, region
        WHERE c_custkey = o_custkey AND l_orderkey = o_orderkey AND l_suppkey = s_suppkey AND c_nationkey = s_nationkey AND s_nationkey = n_nationkey
        AND n_regionkey = r_regionkey AND r_name = 'MIDDLE EAST' AND o_orderdate >= DATE '1996-01-01' AND o_orderdate < DATE '1997-01-01' GROUP BY 1""",
    "q06": """SELECT round(sum(l_extendedprice * l_discount), 4) AS revenue FROM lineitem WHERE l_shipdate >= DATE '1996-01-01'
        AND l_shipdate < DATE '1997-01-01' AND l_discount BETWEEN 0.02 AND 0.04 AND l_quantity < 25""",
    "q07": f"""SELECT n1.n_name AS supp_nation, n2.n_name AS cust_nation, CAST(extract(year FROM l_shipdate) AS INTEGER) AS l_year,
        round(sum({MONEY}), 4) AS revenue FROM supplier, lineitem, orders, customer, nation n1, nation n2
        WHERE s_suppkey = l_suppkey AND o_orderkey = l_orderkey AND c_custkey = o_custkey AND s_nationkey = n1.n_nationkey
        AND c_nationkey = n2.n_nationkey AND ((n1.n_name = 'NATION_1' AND n2.n_name = 'NATION_2') OR (n1.n_name = 'NATION_2' AND n2.n_name = 'NATION_1'))
        AND CAST(l_shipdate AS DATE) BETWEEN DATE '1996-01-01' AND DATE '1997-12-31' GROUP BY 1, 2, 3""",
    "q08": f"""SELECT CAST(extract(year FROM o_orderdate) AS INTEGER) AS o_year,
        round(sum(CASE WHEN n2.n_name = 'NATION_1' THEN {MONEY} ELSE 0 END) / sum({MONEY}), 4) AS mkt_share
        FROM part, supplier, lineitem, orders, customer, nation n1, nation n2, region
        WHERE p_partkey = l_partkey AND s_suppkey = l_suppkey AND l_orderkey = o_orderkey AND o_custkey = c_custkey AND c_nationkey = n1.n_nationkey
        AND n1.n_regionkey = r_regionkey AND r_name = 'AFRICA' AND s_nationkey = n2.n_nationkey
        AND CAST(o_orderdate AS DATE) BETWEEN DATE '1996-01-01' AND DATE '1997-12-31' AND p_type = 'ECONOMY' GROUP BY 1""",
    "q09": f"""SELECT n_name AS nation, CAST(extract(year FROM o_orderdate) AS INTEGER) AS o_year, round(sum({MONEY}), 4) AS sum_profit
        FROM part, lineitem, orders, supplier, nation WHERE p_partkey = l_partkey AND s_suppkey = l_suppkey AND l_orderkey = o_orderkey
        AND s_nationkey = n_nationkey AND p_name LIKE '%widget%' GROUP BY 1, 2""",
    "q10": f"""SELECT c_custkey, c_name, c_acctbal, n_name, round(sum({MONEY}), 4) AS revenue FROM customer, orders, lineitem, nation
        WHERE c_custkey = o_custkey AND l_orderkey = o_orderkey AND c_nationkey = n_nationkey AND l_returnflag = 'R'
        AND o_orderdate >= DATE '1996-01-01' AND o_orderdate < DATE '1996-04-01' GROUP BY 1, 2, 3, 4""",
    "q11": """WITH v AS (SELECT l_partkey, l_extendedprice AS x FROM lineitem, supplier, nation
        WHERE l_suppkey = s_suppkey AND s_nationkey = n_nationkey AND n_name = 'NATION_7')
        SELECT l_partkey, round(sum(x), 2) AS value FROM v GROUP BY 1 HAVING sum(x) > (SELECT sum(x) * 0.001 FROM v)""",
    "q12": """SELECT l_linestatus, CAST(sum(CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 1 ELSE 0 END) AS BIGINT) AS high_line_count,
        CAST(sum(CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 0 ELSE 1 END) AS BIGINT) AS low_line_count
        FROM orders, lineitem WHERE o_orderkey = l_orderkey AND l_shipdate >= DATE '1996-01-01' AND l_shipdate < DATE '1997-01-01' GROUP BY 1""",
    "q14": f"""SELECT round(100 * sum(CASE WHEN p_type LIKE 'PROMO%' THEN {MONEY} ELSE 0 END) / sum({MONEY}), 4) AS promo_revenue
        FROM lineitem, part WHERE l_partkey = p_partkey AND l_shipdate >= DATE '1996-12-01' AND l_shipdate < DATE '1997-01-01'""",
    "q18": """SELECT c_name, c_custkey, o_orderkey, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS o_orderdate, o_totalprice, round(sum(l_quantity), 2) AS sum_quantity
        FROM customer, orders, lineitem WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem GROUP BY 1 HAVING sum(l_quantity) > 250)
        AND c_custkey = o_custkey AND o_orderkey = l_orderkey GROUP BY 1, 2, 3, 4, 5""",
    "q19": f"""SELECT round(sum({MONEY}), 4) AS revenue FROM lineitem, part WHERE p_partkey = l_partkey AND (
        (p_brand = 'Brand#11' AND l_quantity BETWEEN 1 AND 15 AND p_size BETWEEN 1 AND 20) OR
        (p_brand = 'Brand#12' AND l_quantity BETWEEN 10 AND 25 AND p_size BETWEEN 1 AND 30) OR
        (p_brand = 'Brand#13' AND l_quantity BETWEEN 20 AND 35 AND p_size BETWEEN 1 AND 40))""",
}
PLANS = {k: f for k, f in globals().items() if k in SQL}

#: Shapes beyond those plans, as SQL for Spark and, where a cast differs, as it stands for the other engine too.
MORE = {
    "q04_exists": """SELECT o_orderpriority, count(*) AS order_count FROM orders WHERE o_orderdate >= DATE '1996-01-01' AND o_orderdate < DATE '1996-04-01'
        AND EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R') GROUP BY o_orderpriority""",
    "q13_outer_join": """SELECT c_count, count(*) AS custdist FROM (SELECT c_custkey, count(o_orderkey) AS c_count FROM customer
        LEFT OUTER JOIN orders ON c_custkey = o_custkey AND o_orderpriority <> '1-URGENT' GROUP BY c_custkey) t GROUP BY c_count""",
    "q15_top_supplier": f"""WITH r AS (SELECT l_suppkey AS s, round(sum({MONEY}), 4) AS total FROM lineitem
        WHERE l_shipdate >= DATE '1996-01-01' AND l_shipdate < DATE '1996-04-01' GROUP BY l_suppkey)
        SELECT s_suppkey, s_name, total FROM supplier, r WHERE s_suppkey = s AND total = (SELECT max(total) FROM r)""",
    "q16_count_distinct": """SELECT p_brand, p_type, p_size, count(DISTINCT l_suppkey) AS supplier_cnt FROM lineitem, part
        WHERE p_partkey = l_partkey AND p_brand <> 'Brand#21' AND p_type NOT LIKE 'MEDIUM%' AND p_size IN (3, 9, 14, 19, 23, 36, 45, 49)
        GROUP BY p_brand, p_type, p_size""",
    "q17_small_quantity": """SELECT round(sum(l_extendedprice) / 7.0, 2) AS avg_yearly FROM lineitem l, part WHERE p_partkey = l_partkey AND p_brand = 'Brand#23'
        AND l_quantity < (SELECT 0.2 * avg(l_quantity) FROM lineitem x WHERE x.l_partkey = l.l_partkey)""",
    "q20_in_subquery": """SELECT s_name, s_acctbal FROM supplier WHERE s_suppkey IN (SELECT l_suppkey FROM lineitem WHERE l_partkey IN
        (SELECT p_partkey FROM part WHERE p_name LIKE 'small%') AND l_shipdate >= DATE '1996-01-01' AND l_shipdate < DATE '1996-02-01')""",
    "q21_not_exists": """SELECT s_name, count(*) AS numwait FROM supplier, lineitem l1, orders WHERE s_suppkey = l1.l_suppkey AND o_orderkey = l1.l_orderkey
        AND o_orderstatus = 'F' AND EXISTS (SELECT 1 FROM lineitem l2 WHERE l2.l_orderkey = l1.l_orderkey AND l2.l_suppkey <> l1.l_suppkey)
        AND NOT EXISTS (SELECT 1 FROM lineitem l3 WHERE l3.l_orderkey = l1.l_orderkey AND l3.l_suppkey <> l1.l_suppkey AND l3.l_returnflag = 'R')
        GROUP BY s_name""",
    "q22_anti_join": """SELECT c_mktsegment, count(*) AS numcust, round(sum(c_acctbal), 2) AS totacctbal FROM customer
        WHERE c_acctbal > (SELECT avg(c_acctbal) FROM customer WHERE c_acctbal > 0)
        AND NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderdate >= DATE '1998-01-01') GROUP BY c_mktsegment""",
}
