"""Queries of sharding, and their SQL. For the whole table, slots are literals there, which tests fill by brute force; for a
small one, SQL fills them itself."""

from pyspark.sql import DataFrame, SparkSession

from brindle.llm.common import table
from brindle.llm.sharding import SIZE, lookup_table, place

SHARDS = [f"shard-{k:03d}" for k in range(64)]


def op8_shard_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return place(table(spark, sf_dir, "documents").select("doc_id"), "doc_id", SHARDS)


SQL = f"""
WITH d AS (
  SELECT doc_id, CAST(CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) % {SIZE} AS INTEGER) AS slot FROM documents
), t AS (
  SELECT [{",".join(map(str, lookup_table(SHARDS)))}] AS held
)
SELECT doc_id, slot, 'shard-' || lpad(CAST(held[slot + 1] AS VARCHAR), 3, '0') AS shard FROM d, t
"""

SMALL, FEW = 251, [f"shard-{k:03d}" for k in range(7)]


def shard_lookup_small(spark: SparkSession, sf_dir: str) -> DataFrame:
    return place(table(spark, sf_dir, "documents").select("doc_id"), "doc_id", FEW, SMALL)


#: Turn by turn, the next shard takes the first free slot of its preference.
SMALL_SQL = f"""
WITH RECURSIVE h AS (
  SELECT k, 'shard-' || lpad(CAST(k AS VARCHAR), 3, '0') AS name FROM (SELECT unnest(range({len(FEW)})) AS k)
), s AS (
  SELECT k, CAST('0x' || substr(md5('offset:' || name), 1, 15) AS BIGINT) % {SMALL} AS start,
         CAST('0x' || substr(md5('step:' || name), 1, 15) AS BIGINT) % ({SMALL} - 1) + 1 AS step FROM h
), f AS (
  SELECT CAST(0 AS BIGINT) AS turn, list_transform(range({SMALL}), lambda i: CAST(-1 AS BIGINT)) AS held
  UNION ALL
  SELECT turn + 1, list_transform(range({SMALL}), lambda i: CASE WHEN i = took THEN k ELSE held[i + 1] END)
  FROM (SELECT turn, held, k, list_filter(list_transform(range({SMALL}), lambda j: (start + j * step) % {SMALL}), lambda x: held[x + 1] < 0)[1] AS took
        FROM f JOIN s ON k = turn % {len(FEW)} WHERE turn < {SMALL})
), d AS (
  SELECT doc_id, CAST(CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) % {SMALL} AS INTEGER) AS slot FROM documents
)
SELECT doc_id, slot, 'shard-' || lpad(CAST(held[slot + 1] AS VARCHAR), 3, '0') AS shard FROM d, f WHERE turn = {SMALL}
"""

QUERIES = {"op8_shard_lookup": op8_shard_lookup, "shard_lookup_small": shard_lookup_small}
ORACLES = {"op8_shard_lookup": SQL, "shard_lookup_small": SMALL_SQL}
