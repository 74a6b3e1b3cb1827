"""Sinks: report documents, meta datasets and the analysis history."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tablegauge.functions.nulls import json_safe_values


def sink_report_json(report: DataFrame, path: str) -> None:
    """One JSON document per report; NaN and infinities become null."""
    json_safe_values(report).write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def sink_meta_csv(meta: DataFrame, path: str) -> None:
    """The meta dataset with a header row."""
    meta.write.mode("overwrite").option("header", True).csv(path)


def sink_meta_parquet(meta: DataFrame, path: str) -> None:
    meta.write.mode("overwrite").parquet(path)


def sink_history(summary: DataFrame, path: str) -> None:
    """Appends report summaries; earlier entries are never rewritten."""
    summary.write.mode("append").parquet(path)


def read_history(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
