"""Query of the WARC source, and its SQL."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.llm.common import shared_path, table
from brindle.llm.warc import base32, load, page_key, records, register, write


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes the archives, then reads responses with their payloads and revisits by their heads alone.

    A response's length and digest are those of the payload read back, a revisit's those in its record.
    """
    register(spark)
    path = shared_path(spark, "warc")
    write(records(table(spark, sf_dir, "pages")), path)
    # Spark keeps the filters that a source took over with its load: each branch loads anew.
    read = load(spark, path).where("warc_type = 'response'").select(
        page_key("record_id").alias("page_id"), F.octet_length("payload").cast("long").alias("payload_bytes"), base32(F.sha1("payload")).alias("payload_digest"),
        F.col("warc_type").alias("record_type"), F.lit(None).cast("long").alias("refers_to"),
    )
    again = load(spark, path).where("warc_type = 'revisit'").select(
        page_key("record_id").alias("page_id"), "payload_bytes", "payload_digest", F.col("warc_type").alias("record_type"), page_key("refers_to").alias("refers_to")
    )
    return read.union(again)


SQL = """
WITH p AS (
  SELECT page_id, strlen(coalesce(html, '')) AS n, sha1(coalesce(html, '')) AS h, coalesce(html, '') AS t FROM pages
), m AS (
  SELECT *, max(page_id) OVER (PARTITION BY t) AS top FROM p
)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes,
       list_aggregate(list_transform(range(0, 32), lambda i:
         substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(CAST('0x' || substr(h, CAST(i // 4 * 5 + 1 AS BIGINT), 5) AS INTEGER) >> CAST(15 - 5 * (i % 4) AS INTEGER) & 31 AS BIGINT) + 1, 1)), 'string_agg', '') AS payload_digest,
       CASE WHEN page_id IS DISTINCT FROM top AND top IS NOT NULL THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id IS DISTINCT FROM top AND top IS NOT NULL THEN top END AS refers_to
FROM m
"""

QUERIES = {"op10_warc": op10_warc}
ORACLES = {"op10_warc": SQL}
