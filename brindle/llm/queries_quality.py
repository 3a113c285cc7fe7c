"""Query of the quality classifier. SQL cannot express it; its tests measure held-out accuracy."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.llm.common import table
from brindle.llm.langid import held_out
from brindle.llm.quality import QualityModel, classify, fit, trusted

GOOD = 0.7


def quality_model(spark: SparkSession, docs: DataFrame, sf_dir: str) -> QualityModel:
    """Learned from the documents and labels outside the held-out fold."""
    learn = ~held_out(F.col("doc_id"), 4, 2)
    return fit(docs.where(learn), trusted(table(spark, sf_dir, "labels").where(learn)))


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = classify(docs, quality_model(spark, docs, sf_dir), score="score")
    predicted = (F.col("score") >= GOOD).cast("int")
    return scored.select("doc_id", held_out(F.col("doc_id"), 4, 2).alias("held_out"), "score", predicted.alias("predicted"))


QUERIES = {"op1_quality_classifier": op1_quality_classifier}
ORACLES: dict[str, str] = {}
