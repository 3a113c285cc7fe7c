"""Query of the source mixer, and its SQL."""

from pyspark.sql import DataFrame, SparkSession

from brindle.llm.common import table
from brindle.llm.mixing import mix


def op2_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


#: Every quotient of every source and shard is ranked here; the targets come from dealing the excess anew until none is above.
SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         md5(concat('42:', coalesce(CAST(doc_id AS VARCHAR), ''))) AS h
  FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, count(*) AS n_docs,
         row_number() OVER (ORDER BY source IS NULL, encode(source)) AS place
  FROM d GROUP BY source
), w AS (
  SELECT *, [5, 2, 1][(place - 1) % 3 + 1] AS weight, 3 * source_size AS cap,
         CAST(sum(source_size) OVER () AS BIGINT) AS total, greatest(1, ceil(source_size / 1048576), ceil(n_docs / 4096))::BIGINT AS n_shards
  FROM s
), f AS (
  SELECT 0 AS round, source, place, weight, cap, total, n_shards, source_size, false AS capped FROM w
  UNION ALL
  SELECT round + 1, source, place, weight, cap, total, n_shards, source_size,
         capped OR cap / weight <= (total - coalesce(sum(cap) FILTER (capped) OVER (), 0)) / sum(weight) FILTER (NOT capped) OVER ()
  FROM f WHERE round < 30
), t AS (
  SELECT *, CASE WHEN capped THEN CAST(cap AS DOUBLE) ELSE CAST(total - coalesce(sum(cap) FILTER (capped) OVER (), 0) AS DOUBLE)
            / CAST(sum(weight) FILTER (NOT capped) OVER () AS DOUBLE) * weight END AS target,
         CASE WHEN total > 0 THEN greatest(1, round(total / 64))::BIGINT ELSE 0 END AS blocks
  FROM f WHERE round = 30
), q AS (
  SELECT place, count(*) AS quota FROM (
    SELECT place, blocks, row_number() OVER (ORDER BY target / (2 * k + 1) DESC, place) AS r
    FROM (SELECT place, target, blocks, unnest(range(0, blocks)) AS k FROM t WHERE target > 0)) WHERE r <= blocks GROUP BY place
), p AS (
  SELECT d.*, t.place, t.target, t.source_size, coalesce(q.quota, 0) AS quota, CAST('0x' || substr(h, 1, 8) AS BIGINT) % n_shards AS shard
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source LEFT JOIN q ON t.place = q.place
), sh AS (
  SELECT place, shard, quota, CAST(sum(size) AS BIGINT) AS words FROM p GROUP BY ALL
), sq AS (
  SELECT place, shard, count(*) AS blocks FROM (
    SELECT place, shard, quota, row_number() OVER (PARTITION BY place ORDER BY words / (2 * k + 1) DESC, shard) AS r
    FROM (SELECT *, unnest(range(0, quota)) AS k FROM sh WHERE words > 0)) WHERE r <= quota GROUP BY ALL
), st AS (
  SELECT sh.place, sh.shard, words, least(coalesce(sq.blocks, 0) * 64, 3 * words) AS take
  FROM sh LEFT JOIN sq ON sh.place = sq.place AND sh.shard = sq.shard
), o AS (
  SELECT p.*, CAST(sum(size) OVER (PARTITION BY place, shard ORDER BY h, doc_id, size ROWS UNBOUNDED PRECEDING) AS BIGINT) - size AS start FROM p
)
SELECT doc_id, size, source_size, target,
       CAST(CASE WHEN words > 0 THEN take // words * size + least(greatest(take % words - start, 0), size) ELSE 0 END AS BIGINT) AS taken
FROM o JOIN st USING (place, shard)
"""

QUERIES = {"op2_source_mix": op2_source_mix}
ORACLES = {"op2_source_mix": SQL}
