"""Query of the packing operator."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tablegauge.llm.common import table
from tablegauge.llm.packing import pack


def tokenizer_file(name: str = "byte_bpe_50k.json") -> str:
    """Where the installed collection of public vocabularies keeps a file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of at most 1,024 tokens."""
    return pack(table(spark, sf_dir, "documents"), tokenizer_file())


QUERIES = {"op1_best_fit_packing": op1_best_fit_packing}
