"""Query of the language-model scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tablegauge.llm.common import table
from tablegauge.llm.lm_scoring import score_texts
from tablegauge.llm.packing_query import tokenizer_file


def op10_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents under models learned from six sevenths of them."""
    return score_texts(table(spark, sf_dir, "documents"), tokenizer_file())


QUERIES = {"op10_lm_scoring": op10_lm_scoring}
