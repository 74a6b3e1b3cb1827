"""The analysis of many tables: a report each, relationships, and a comparison."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablegauge.functions.failures import cannot_read
from tablegauge.functions.session import local_rows
from tablegauge.operators import relate as L
from tablegauge.plans.analyze import TableReport
from tablegauge.sources.readers import scan_archive, scan_by_extension, scan_catalog


class Comparison:
    """Reports by table, the tables that failed, relationships, ranking and worst columns."""

    def __init__(self, spark: SparkSession, tables: dict[str, DataFrame], target: str | None = None,
                 errors: DataFrame | None = None):
        self.spark = spark
        self.reports: dict[str, TableReport] = {}
        failed = []
        for name, df in tables.items():
            try:
                self.reports[name] = TableReport(name, df, target)
            except Exception as exc:  # the other tables go on
                if not cannot_read(exc):
                    raise
                failed.append((name, str(exc).splitlines()[0][:500]))
        own = local_rows(spark, failed, "table_name string, error string")
        self.errors = own if errors is None else errors.unionByName(own)
        self.relationships = L.relationship_report(spark, {n: tables[n] for n in self.reports})
        summaries = [r.summary().first().asDict() for r in self.reports.values()]
        self.ranking = L.table_ranking(spark, summaries)
        self.best_worst = L.best_worst_table(self.ranking)
        gaps = [r.checks.missing.select(F.lit(n).alias("table_name"), "col", "pct", "risk")
                for n, r in self.reports.items()]
        empty = local_rows(spark, [], "table_name string, col string, pct double, risk string")
        self.problem_columns = L.problem_columns_topk(reduce(DataFrame.unionByName, gaps, empty))


def compare(spark: SparkSession, tables: dict[str, DataFrame], target: str | None = None) -> Comparison:
    return Comparison(spark, tables, target)


def analyze_path(spark: SparkSession, path: str, target: str | None = None) -> TableReport | Comparison:
    """A file by its extension, a ZIP archive of files, or a folder of files."""
    lower = path.lower().rstrip("/")
    if lower.endswith(".zip"):
        tables, errors = scan_archive(spark, path)
        return Comparison(spark, tables, target, errors)
    name = path.rstrip("/").rsplit("/", 1)[-1]
    if "." in name:
        return TableReport(name, scan_by_extension(spark, path), target)
    tables, errors = scan_catalog(spark, path)
    return Comparison(spark, tables, target, errors)
