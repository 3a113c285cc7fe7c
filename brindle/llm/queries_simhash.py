"""Query of SimHash near-duplicates. DuckDB has no seeded XXH64; a brute-force version tests it."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.llm.common import table
from brindle.llm.simhash import grouped, hexed


def op3_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = grouped(table(spark, sf_dir, "documents"))
    return found.select("doc_id", hexed(F.col("fp")).alias("fingerprint"), "component_id")


QUERIES = {"op3_simhash_dedup": op3_simhash_dedup}
ORACLES: dict[str, str] = {}
