"""Query of the page extraction."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tablegauge.llm.common import table
from tablegauge.llm.html_text import extract_text


def op8_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return extract_text(table(spark, sf_dir, "pages"))


QUERIES = {"op8_html_extraction": op8_html_extraction}
