"""Target suggestions and training readiness."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablegauge.functions import keywords as K
from tablegauge.functions import names as N
from tablegauge.functions import rules as R
from tablegauge.functions.nulls import normalize_nulls, quoted
from tablegauge.functions.session import local_rows
from tablegauge.operators.correlation import correlations, numeric_columns, varies
from tablegauge.operators.profile import TableProfile, per_column


def suggest_targets(profile: TableProfile) -> DataFrame:
    """Up to five likely targets, best first: keyword 0.5, few distinct 0.3, not numeric 0.2."""
    c = F.col
    numeric = c("dtype_class").isin("numeric", "boolean")
    points = (
        F.when(N.contains_any(c("name"), K.TARGET_WORDS), 0.5).otherwise(0.0)
        + F.when(N.few_distinct(c("distinct"), c("n_rows")), 0.3).otherwise(0.0)
        + F.when(numeric, 0.0).otherwise(0.2)
    )
    return (
        profile.raw.filter("n_rows > 0")
        .filter(~N.is_id_like(c("name"), c("distinct"), c("n_rows")))
        .select("ordinal", c("name").alias("column"), F.round(F.least(points, F.lit(1.0)), 2).alias("confidence"),
                c("distinct").alias("unique_values"), c("dtype_raw").alias("dtype"))
        .filter("confidence > 0")
        .orderBy(F.desc("confidence"), "ordinal")
        .limit(5)
    )


def task_type(profile: TableProfile, target: str) -> str:
    """classification unless the target is numeric with more than 20 distinct values."""
    c = profile.facts[target]
    numeric = c.dtype_class in ("numeric", "boolean")
    return "regression" if numeric and (c.distinct or 0) > K.FEW_DISTINCT else "classification"


def class_counts(df: DataFrame, target: str) -> DataFrame:
    """``class, count`` of the non-null target values, most frequent first."""
    df = normalize_nulls(df)
    return (
        df.select(quoted(target).cast("string").alias("class")).dropna()
        .groupBy("class").agg(F.count("*").alias("count"))
        .orderBy(F.desc("count"), "class")
    )


def class_imbalance(df: DataFrame, target: str) -> DataFrame:
    """One row: dominant class and its share, share of the rarest class, risk."""
    c = F.col
    counts = class_counts(df, target)
    got = counts.agg(
        F.sum("count").alias("n"), F.count("*").alias("classes"),
        F.min(F.struct((-c("count")).alias("neg"), c("class").alias("class"))).alias("top"),
        F.min("count").alias("least"),
    )
    dominant = F.round(F.try_divide(-c("top.neg"), c("n")) * 100, 2)
    rarest = F.round(F.try_divide("least", "n") * 100, 2)
    return got.select(
        c("top.class").alias("dominant_class"), dominant.alias("dominant_pct"),
        F.when(c("classes") > 1, rarest).otherwise(dominant).alias("minority_pct"),
        R.imbalance_risk(F.coalesce(dominant, F.lit(0.0))).alias("risk"),
    )


def target_skewness(df: DataFrame, target: str) -> DataFrame:
    """One row: population skewness of a numeric target, 0 below three values, NULL if constant."""
    x = quoted(target).cast("double")
    got = normalize_nulls(df).agg(F.count(x).alias("n"), F.when(varies(x), F.skewness(x)).alias("g1"))
    skew = F.when(F.col("n") < 3, 0.0).otherwise(F.col("g1"))
    return got.select(F.round(skew, 4).alias("target_skewness"))


def leakage_columns(df: DataFrame, target: str) -> DataFrame:
    """Numeric features whose |r| with a numeric target is above 0.95."""
    numeric = numeric_columns(df)
    pairs = [(c, target) for c in numeric if c != target] if target in numeric else []
    found = correlations(normalize_nulls(df), pairs)
    rows = [(i, c, r) for i, ((c, _), r) in enumerate(found.items()) if r is not None and abs(r) > 0.95]
    return local_rows(df.sparkSession, rows, "position int, col string, r double").select(
        "position", "col", F.round("r", 3).alias("correlation"))


def low_variance(df: DataFrame, target: str | None = None) -> DataFrame:
    """Numeric features with a sample variance below 0.01."""
    names = [c for c in numeric_columns(df) if c != target]
    if not names:
        return local_rows(df.sparkSession, [], "col string, variance double")
    got = per_column(df, names, variance=lambda x: F.var_samp(x.cast("double")))
    return got.filter(F.col("variance") < 0.01).select(
        F.col("name").alias("col"), F.round("variance", 6).alias("variance"))


class Readiness:
    """Readiness facts of one table for one target."""

    def __init__(self, df: DataFrame, profile: TableProfile, target: str):
        self.target = target
        self.task_type = task_type(profile, target)
        rest = [c for c in profile.facts.columns if c.name != target]
        self.constant_features = [c.name for c in rest if c.distinct is not None and c.distinct <= 1]
        self.low_variance_features = [
            c.name for c in rest
            if c.has_stats and c.variance is not None and math.isfinite(c.variance) and c.variance < 0.01
        ]
        self.leakage = leakage_columns(df, target)
        self.leakage_risk_cols = [r["col"] for r in self.leakage.orderBy("position").collect()]
        self.imbalance = self.class_counts = None
        self.target_skewness = None
        if self.task_type == "classification":
            self.class_counts = class_counts(df, target)
            self.imbalance = class_imbalance(df, target).first().asDict()
        else:
            skew = profile.facts[target].skewness
            self.target_skewness = None if skew is None else round(skew, 4)
