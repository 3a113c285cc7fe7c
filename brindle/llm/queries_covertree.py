"""Query of embedding near-duplicates, and its SQL."""

from pyspark.sql import DataFrame, SparkSession

from brindle.llm.common import table
from brindle.llm.covertree import grouped


def op7_cover_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grouped(table(spark, sf_dir, "embeddings"))


#: Rows are told apart by ``k``, since ids may repeat or be null.
SQL = """
WITH RECURSIVE e AS (
  SELECT row_number() OVER () AS k, vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings
), ok AS (
  SELECT * FROM e WHERE label IS NOT NULL AND v IS NOT NULL AND len(v) > 0
    AND len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(v, lambda x: x <> 0)) > 0
), l AS (
  SELECT a.k AS a, b.k AS b FROM ok a JOIN ok b
    ON a.label = b.label AND a.k <> b.k AND len(a.v) = len(b.v)
   AND list_inner_product(a.v, b.v) / (sqrt(list_inner_product(a.v, a.v)) * sqrt(list_inner_product(b.v, b.v))) >= 0.98
), r AS (
  SELECT k AS a, k AS b FROM e
  UNION
  SELECT r.a, l.b FROM r JOIN l ON r.b = l.a
), c AS (
  SELECT r.a, min(e.vec_id) AS component_id FROM r JOIN e ON e.k = r.b GROUP BY r.a
), n AS (
  SELECT a, count(*) AS n_links FROM l GROUP BY a
)
SELECT e.vec_id, CAST(coalesce(n_links, 0) AS BIGINT) AS n_links, component_id, e.vec_id IS NOT DISTINCT FROM component_id AS kept
FROM e JOIN c ON c.a = e.k LEFT JOIN n ON n.a = e.k
"""

QUERIES = {"op7_cover_tree": op7_cover_tree}
ORACLES = {"op7_cover_tree": SQL}
