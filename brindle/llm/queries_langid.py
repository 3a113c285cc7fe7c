"""Query of language identification. SQL cannot express it; its tests measure held-out accuracy."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.llm.common import table
from brindle.llm.langid import fit, held_out, identify


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = held_out(F.col("doc_id"), 3, 1)
    model = fit(docs.where(~out))
    return identify(docs.select("doc_id", "text"), model, score="score").select("doc_id", out.alias("held_out"), "lang_pred", "score")


QUERIES = {"op6_language_id": op6_language_id}
ORACLES: dict[str, str] = {}
