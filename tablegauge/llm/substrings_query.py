"""Query of the removal of repeated passages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablegauge.llm.common import table
from tablegauge.llm.substrings import remove_repeats


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of all documents left after repeated passages of twenty words are removed."""
    found = remove_repeats(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


QUERIES = {"op2_substring_dedup": op2_substring_dedup}
