"""Query of byte-level BPE. SQL cannot express it; its tests compare it with the tokenizer library itself."""

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.llm.bpe import decode, encode, read_ranks
from brindle.llm.common import table


def digests(docs: DataFrame, ranks: dict[bytes, int]) -> DataFrame:
    """Ids of every text and of the bytes they decode to, as counts and SHA-256 digests."""
    both = decode(encode(docs, ranks, public_tokenizers.PATTERN), ranks)
    joined = F.array_join(F.col("ids").cast("array<string>"), " ")
    return both.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(joined, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")
    )


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"), read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")))


QUERIES = {"op9_byte_bpe": op9_byte_bpe}
ORACLES: dict[str, str] = {}
