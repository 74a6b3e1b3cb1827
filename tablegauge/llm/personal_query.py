"""Query of the search for personal data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablegauge.llm.common import table
from tablegauge.llm.personal import KINDS, find_personal
from tablegauge.llm.secrets_query import _count, _listed


def op13_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data of all documents; counts and digest are of those written plainly."""
    found = find_personal(table(spark, sf_dir, "documents")).withColumn("base", F.filter("spans", lambda s: s["plain"]))
    return found.select("doc_id", *[_count(F.col("base"), kind) for kind in KINDS], F.sha2(_listed(F.col("base")), 256).alias("base_sha256"), _listed(F.col("spans")).alias("spans"))


QUERIES = {"op13_personal_data": op13_personal_data}
