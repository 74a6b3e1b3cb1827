"""The whole analysis of one table: profile, checks, readiness, score, distributions, advice."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablegauge.functions import keywords as K
from tablegauge.functions.names import resolve_target
from tablegauge.functions.nulls import normalize_nulls
from tablegauge.functions.session import local_rows, staged, together
from tablegauge.operators import distributions as X
from tablegauge.operators.checks import TableChecks, correlation_pairs
from tablegauge.operators.duplicates import duplicate_count
from tablegauge.operators.facts import collect_facts
from tablegauge.operators.profile import TableProfile
from tablegauge.operators.readiness import Readiness, suggest_targets
from tablegauge.operators.recommend import FIELDS, recommendations
from tablegauge.operators.score import issues, score, severity_counts


def importance_groups(profile: TableProfile) -> DataFrame:
    """``importance, columns, n_columns``: column names per importance class, empty classes kept."""
    spark = profile.spark
    levels = local_rows(spark, [(v, i) for i, v in enumerate(K.IMPORTANCES)], "importance string, rank int")
    listed = profile.columns.groupBy("importance").agg(F.transform(
        F.array_sort(F.collect_list(F.struct("ordinal", "name"))), lambda s: s["name"]).alias("names"))
    joined = levels.join(F.broadcast(listed), "importance", "left")  # a row per class on both sides
    names = F.coalesce("names", F.array().cast("array<string>"))
    return joined.select("importance", "rank", names.alias("columns"), F.size(names).cast("long").alias("n_columns"))


def _rows_of(df: DataFrame, order: list[str], fields: list[str] | None = None) -> DataFrame:
    """The few rows of a result as one ordered array of structs."""
    fields = fields or [c for c in df.columns if c not in order]
    key = F.struct(*[F.col(c).alias(f"k{i}") for i, c in enumerate(order)])
    pairs = F.array_sort(F.collect_list(F.struct(key.alias("k"), F.struct(*fields).alias("v"))))
    return df.agg(F.transform(pairs, lambda p: p["v"]).alias("rows"))


class TableReport:
    """Results of one analysis. Each attribute is a small DataFrame; the passes have been made."""

    def __init__(self, name: str, df: DataFrame, target: str | None = None):
        self.name = name
        self.target_used = None
        if target:
            try:
                self.target_used = resolve_target(df, target)
            except KeyError:
                pass  # the table is analysed without a target
        self.spark = df.sparkSession
        df = normalize_nulls(df)
        with staged(df) as rows:
            facts, copies = together([lambda: collect_facts(rows), lambda: duplicate_count(rows).first()[0]])
            if not facts.rows:
                raise ValueError("empty table")
            self.profile = TableProfile(df, facts, self.target_used, copies)
            self.checks = TableChecks(rows, self.profile, correlation_pairs(rows, self.profile))
            self.readiness = Readiness(rows, self.profile, self.target_used) if self.target_used else None
            self.histograms = self._kept(X.histogram(rows, facts, X.histogram_columns(facts, self.target_used)))
            self.bars = self._kept(X.category_bars(rows, X.bar_columns(rows, facts, self.target_used)))
            self.matrix = X.correlation_matrix(rows, self.profile, self.target_used)
            self.class_counts = None
            if self.readiness is not None and self.readiness.class_counts is not None:
                # A classification target may be text with very many values: stays lazy.
                self.class_counts = self.readiness.class_counts

    def _kept(self, df: DataFrame) -> DataFrame:
        """A result of at most some dozens of rows, computed while the input is at hand."""
        return local_rows(self.spark, [tuple(r) for r in df.collect()], df.schema)

    @cached_property
    def issues(self) -> DataFrame:
        return issues(self.checks)

    @cached_property
    def severity(self) -> DataFrame:
        return severity_counts(self.issues)

    @cached_property
    def score(self) -> DataFrame:
        return score(self.checks)

    @cached_property
    def suggested_targets(self) -> DataFrame:
        return suggest_targets(self.profile)

    @cached_property
    def recommendations(self) -> DataFrame:
        return recommendations(self.checks, self.readiness)

    def summary(self) -> DataFrame:
        """One row for the history and the ranking of tables."""
        level = F.col("severity")
        counts = self.severity.agg(
            *[F.sum(F.when(level == s, F.col("issues")).otherwise(0)).alias(f"{s.lower()}_issues") for s in K.SEVERITIES])
        best = self.score.select(F.col("total").alias("score"), "grade")
        overview = self.profile.overview.select("rows", "columns", "missing_pct", "duplicate_pct")
        row = best.crossJoin(F.broadcast(overview)).crossJoin(F.broadcast(counts))  # one row each
        return row.select(F.lit(self.name).alias("table_name"), F.lit(self.target_used).alias("target_used"), "*")

    def document(self) -> DataFrame:
        """The report as one nested row, ready for ``sink_report_json``."""
        c = self.checks
        parts: dict[str, DataFrame] = {
            "overview": self.profile.overview.select(F.struct("*").alias("rows")),
            "columns": _rows_of(self.profile.columns, ["ordinal"]),
            "missing": _rows_of(c.missing.withColumn("worst", _rank("risk")).withColumn("less", -F.col("pct")),
                                ["worst", "less", "ordinal"], ["col", "missing", "pct", "risk", "importance"]),
            "duplicates": c.duplicates.select(F.struct("*").alias("rows")),
            "outliers": _rows_of(c.outliers, ["ordinal"]),
            "wrong_types": _rows_of(c.wrong_types, ["ordinal"]),
            "negative_invalid": _rows_of(c.negative_invalid, ["ordinal"]),
            "zero_invalid": _rows_of(c.zero_invalid, ["ordinal"]),
            "skewness": _rows_of(c.skewness, ["ordinal"]),
            "correlation": _rows_of(c.correlation, ["position"]),
            "score": self.score.select(F.struct("*").alias("rows")),
            "severity": _rows_of(self.severity, ["rank"], ["severity", "issues"]),
            "issues": _rows_of(self.issues, ["block", "position"]),
            "suggested_targets": _rows_of(
                self.suggested_targets.withColumn("less", -F.col("confidence")), ["less", "ordinal"],
                ["column", "confidence", "unique_values", "dtype"]),
            "importance": _rows_of(importance_groups(self.profile), ["rank"], ["importance", "columns"]),
            "histograms": _rows_of(self.histograms, ["col", "bin"], ["col", "bin", "label", "count"]),
            "bars": _rows_of(self.bars, ["col", "rank"], ["col", "rank", "value", "count"]),
            "correlation_matrix": _rows_of(self.matrix, ["row_no", "col_no"], ["col1", "col2", "r"]),
            "recommendations": _rows_of(self.recommendations, ["block", "position"], list(FIELDS)),
        }
        row = local_rows(self.spark, [(self.name, self.target_used)], "table_name string, target_used string")
        for label, part in parts.items():
            row = row.crossJoin(F.broadcast(part.withColumnRenamed("rows", label)))  # one row each
        r = self.readiness
        ready = F.lit(None).cast("string") if r is None else F.lit(r.task_type)
        return row.withColumns({
            "task_type": ready,
            "leakage_risk_cols": _texts([] if r is None else r.leakage_risk_cols),
            "constant_features": _texts([] if r is None else r.constant_features),
            "low_variance_features": _texts([] if r is None else r.low_variance_features),
            "dominant_class": _lit(r.imbalance and r.imbalance["dominant_class"] if r else None, "string"),
            "dominant_pct": _lit(r.imbalance and r.imbalance["dominant_pct"] if r else None, "double"),
            "target_skewness": _lit(r.target_skewness if r else None, "double"),
        })


def _rank(col: str) -> Column:
    from tablegauge.functions.rules import severity_rank

    return severity_rank(F.col(col))


def _texts(values: list[str]) -> Column:
    return F.array(*[F.lit(v) for v in values]).cast("array<string>")


def _lit(value, kind: str) -> Column:
    return F.lit(value).cast(kind)


def analyze(df: DataFrame, target: str | None = None, name: str = "table") -> TableReport:
    """Analyse one table; an unknown target is ignored, an empty table is an error."""
    return TableReport(name, df, target)
