"""Query of the near-duplicate operator."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tablegauge.llm.common import table
from tablegauge.llm.simhash import near_duplicates


def op9_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document, linked at three or fewer differing bits."""
    return near_duplicates(table(spark, sf_dir, "documents"))


QUERIES = {"op9_simhash_near_dedup": op9_simhash_near_dedup}
