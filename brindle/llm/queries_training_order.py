"""Query of training-order materialisation. SQL cannot express it; tests hold it against a brute-force version of the whole order."""

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from brindle.llm.bpe import read_ranks
from brindle.llm.common import shared_path, table
from brindle.llm.training_order import layout, materialise, read

SEQ_LEN = 256


def op5_training_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes the shards of all documents, then reads every record back from them."""
    ranks = read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    path = shared_path(spark, "training-order")
    manifest = materialise(table(spark, sf_dir, "documents"), path, ranks, public_tokenizers.PATTERN, seq_len=SEQ_LEN)
    return read(manifest, path, layout(ranks, SEQ_LEN), digest=True)


QUERIES = {"op5_training_order": op5_training_order}
ORACLES: dict[str, str] = {}
