"""A corpus pipeline of five stages over the documents table; each works on what the one before it kept.

Every stage but the last returns the columns of documents; run() writes each result as Parquet and reads it again.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.llm.bpe import read_ranks
from brindle.llm.common import shared_path
from brindle.llm.langid import UNKNOWN, fit, held_out, identify
from brindle.llm.mixing import copies
from brindle.llm.quality import classify
from brindle.llm.queries_bpe import digests
from brindle.llm.queries_quality import GOOD, quality_model
from brindle.llm.simhash import representatives
from brindle.scratch import passing, remove

#: A text goes where, even by chance (three standard deviations), no such share of its words would be known.
FAMILIAR = 0.2


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Goes: documents without a letter (null and empty ones among them), documents in a declared language that the model
    knows and does not find in them, and documents of too few known words to be of any language that it knows. Short texts
    have the benefit of the doubt.

    What stays has a language: that found, where none was declared. Repeated rows are judged alike, each staying or going
    with its copies; an empty table stays empty, and where no row has a language, all rows with a letter go as unknown.
    """
    model = fit(docs.where(~held_out(F.col("doc_id"), 3, 1)))
    found = identify(docs, model, pred="_lang", score="_sure", words="_words", known="_known")
    n, k = F.col("_words"), F.col("_known")
    share_at_most = (k + 4.5 + 3 * F.sqrt(k * (n - k) / n + 2.25)) / (n + 9)
    declared = F.col("lang").cast("string")
    agrees = declared.isNull() | (declared == F.col("_lang")) | ~declared.isin(model.langs)
    kept = found.where((F.col("_lang") != UNKNOWN) & agrees & (share_at_most >= FAMILIAR))
    return kept.withColumn("lang", F.coalesce("lang", F.col("_lang").cast(docs.schema["lang"].dataType))).select(*docs.columns)


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Goes: documents that score under GOOD. Null and empty texts are scored like others, and repeated rows alike; an empty
    table stays empty. Where there is nothing to learn from, every score is 0.5 and all goes."""
    scored = classify(docs, quality_model(spark, docs, sf_dir), score="_score")
    return scored.where(F.col("_score") >= GOOD).select(*docs.columns)


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Goes: all but the document with the smallest id of each group of near-duplicates, as op3 has them.

    That is 3-word shingles and fingerprints within 3 bits, not a five-word similarity of 0.8: most near copies by the
    latter stay (README). Of repeated rows one stays, also where their id is null, which counts as the largest. Null and
    empty texts are one group; an empty table stays empty.
    """
    return representatives(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A document stands as often as the mix takes it whole; what it takes of it beyond that is a row of its own.

    Null and empty texts have no words, so they go. Null sources are one source, and repeated rows documents of their own;
    an empty table stays empty.
    """
    return copies(docs)


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Number of ids, and digests of the ids and of the bytes they decode to: a row for each row, also for repeated ones and
    those with null ids; null and empty texts have no ids."""
    return digests(docs, read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")))


STAGES = [
    ("language_id", language_id),
    ("quality_classifier", quality_classifier),
    ("simhash_dedup", simhash_dedup),
    ("source_mix", source_mix),
    ("byte_bpe", byte_bpe),
]

#: The classifiers, XXH64 and the tokenizer are beyond SQL; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. What a stage stored goes when its result is written, and that result when the next one's is."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        path = shared_path(spark, name)
        with passing(spark):
            stage(spark, docs, sf_dir).write.parquet(path)
        if before:
            remove(spark, before)
        docs, before = spark.read.parquet(path), path
    return docs
