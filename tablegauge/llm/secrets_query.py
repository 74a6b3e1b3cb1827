"""Query of the secret scan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tablegauge.llm.common import table
from tablegauge.llm.secrets import KINDS, scan_secrets


def _listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def _count(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")


def op6_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of all documents; counts and digest are of those that stand in the text itself."""
    found = scan_secrets(table(spark, sf_dir, "documents")).withColumn("base", F.filter("spans", lambda s: s["depth"] == 0))
    return found.select(
        "doc_id", *[_count(F.col("base"), kind) for kind in KINDS], F.sha2(_listed(F.col("base")), 256).alias("base_sha256"),
        _listed(F.col("spans")).alias("spans"), "n_layers", "n_refused")


QUERIES = {"op6_secret_scans": op6_secret_scans}
