"""A corpus pipeline of five stages: language, near-duplicates, benchmark passages, secrets, packing.

Every stage takes the documents that its predecessor kept, and all but the last return documents with the same
columns. A document is kept as it is, dropped whole, or, by the secret stage, freed of its secrets.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tablegauge.llm.common import staged, table
from tablegauge.llm.decontaminate import decontaminate
from tablegauge.llm.language import accepted, fit
from tablegauge.llm.packing import pack
from tablegauge.llm.packing_query import tokenizer_file
from tablegauge.llm.secrets import redact_secrets
from tablegauge.llm.simhash import near_duplicates


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that their labels teach; those that the classifier rejects go."""
    return accepted(docs, fit(docs))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: the one with the least id.

    Of rows that repeat an id the one with the least text hash stays; rows without an id stay.
    """
    first = near_duplicates(docs).where("doc_id = component_id").select("doc_id").distinct()
    nth = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.xxhash64("text")))
    kept = docs.join(first.hint("merge"), "doc_id", "left_semi").select("*", nth.alias("_nth")).where("_nth = 1").drop("_nth")
    return kept.select(docs.columns).unionByName(docs.where(F.col("doc_id").isNull()))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark passage."""
    found = decontaminate(docs, table(spark, sf_dir, "benchmark")).where("contaminated")
    found = found.select(F.col("doc_id").alias("_id"), F.col("text_xxhash64").alias("_version")).distinct()
    return docs.join(found, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.xxhash64("text") == F.col("_version")), "left_anti").select(docs.columns)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with every secret in the text replaced by its kind."""
    out = redact_secrets(docs)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))
    return out


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of at most 1,024 tokens."""
    return pack(docs, tokenizer_file())


STAGES = [("language", language), ("near_dedup", near_dedup), ("decontamination", decontamination), ("secrets", secrets), ("packing", packing)]

#: Fingerprints, classifiers and tokenizers are beyond SQL; the tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The result of all stages over the documents; each stage's rows are written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)


def registered() -> tuple[dict, dict]:
    """The pipeline as a query, and its SQL if there is any."""
    return {"pipeline": run}, {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
