"""Loading of the star-schema tables, and the schemas of delimited inputs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem")
#: Columns without repeated values.
KEYS = frozenset({"r_regionkey", "n_nationkey", "c_custkey", "s_suppkey", "p_partkey", "o_orderkey"})
#: Timestamps without a time of day that are dates in the data model.
DATES = {"orders": ("o_orderdate",), "lineitem": ("l_shipdate",)}

#: Typed, nullable test tables and the TPC-H tables as delimited text: fixed column names and types, in file order.
SCHEMAS = {
    "people": "id int, name string",
    "info": "id int, cheated boolean, date date, zscore double, num1 smallint, num2 bigint",
    "region": "r_regionkey int, r_name string, r_comment string",
    "nation": "n_nationkey int, n_name string, n_regionkey int, n_comment string",
    "supplier": "s_suppkey int, s_name string, s_address string, s_nationkey int, s_phone string, s_acctbal double, s_comment string",
    "customer": "c_custkey int, c_name string, c_address string, c_nationkey int, c_phone string, c_acctbal double, c_mktsegment string, c_comment string",
    "part": "p_partkey int, p_name string, p_mfgr string, p_brand string, p_type string, p_size int, p_container string, p_retailprice double, p_comment string",
    "partsupp": "ps_partkey int, ps_suppkey int, ps_availqty int, ps_supplycost double, ps_comment string",
    "orders": "o_orderkey int, o_custkey int, o_orderstatus string, o_totalprice double, o_orderdate date, o_orderpriority string, o_clerk string, o_shippriority int, o_comment string",
    "lineitem": (
        "l_orderkey int, l_partkey int, l_suppkey int, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double, "
        "l_returnflag string, l_linestatus string, l_shipdate date, l_commitdate date, l_receiptdate date, l_shipinstruct string, l_shipmode string, l_comment string"
    ),
}

_INTS = "id person_id movie_id person_role_id nr_order role_id imdb_id subject_id status_id company_id company_type_id info_type_id kind_id keyword_id linked_movie_id link_type_id production_year episode_of_id season_nr episode_nr"
#: The movie database of the join-order benchmark: fixed column names, in file order. Columns in _INTS are ints, others text.
MOVIES = {
    "aka_name": "id person_id name imdb_index name_pcode_cf name_pcode_nf surname_pcode md5sum",
    "aka_title": "id movie_id title imdb_index kind_id production_year phonetic_code episode_of_id season_nr episode_nr note md5sum",
    "cast_info": "id person_id movie_id person_role_id note nr_order role_id",
    "char_name": "id name imdb_index imdb_id name_pcode_nf surname_pcode md5sum",
    "comp_cast_type": "id kind",
    "company_name": "id name country_code imdb_id name_pcode_nf name_pcode_sf md5sum",
    "company_type": "id kind",
    "complete_cast": "id movie_id subject_id status_id",
    "info_type": "id info",
    "keyword": "id keyword phonetic_code",
    "kind_type": "id kind",
    "link_type": "id link",
    "movie_companies": "id movie_id company_id company_type_id note",
    "movie_info": "id movie_id info_type_id info note",
    "movie_info_idx": "id movie_id info_type_id info note",
    "movie_keyword": "id movie_id keyword_id",
    "movie_link": "id movie_id linked_movie_id link_type_id",
    "name": "id name imdb_index imdb_id gender name_pcode_cf name_pcode_nf surname_pcode md5sum",
    "person_info": "id person_id info_type_id info note",
    "role_type": "id role",
    "title": "id title imdb_index kind_id production_year imdb_id phonetic_code episode_of_id season_nr episode_nr series_years md5sum",
}
MOVIE_SCHEMAS = {t: ", ".join(f"{c} {'int' if c in _INTS.split() else 'string'}" for c in cols.split()) for t, cols in MOVIES.items()}


class Database:
    """Tables by name, read from Parquet below a folder; ``db["orders"]`` is a DataFrame with dates as dates."""

    def __init__(self, spark: SparkSession, sf_dir: str, tables: Sequence[str] = TABLES):
        self.spark, self.dir, self.tables = spark, sf_dir.rstrip("/"), tuple(tables)

    def __getitem__(self, name: str) -> DataFrame:
        df = self.spark.read.parquet(f"{self.dir}/{name}.parquet")
        return df.withColumns({c: F.col(c).cast("date") for c in DATES.get(name, ())})

    def __contains__(self, name: str) -> bool:
        return name in self.tables

    def register(self) -> None:
        """Every table as a temporary view of its name."""
        for name in self.tables:
            self[name].createOrReplaceTempView(name)
