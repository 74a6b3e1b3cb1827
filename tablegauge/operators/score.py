"""Issues, severity counts and the 0-100 score, from check results alone."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablegauge.functions import keywords as K
from tablegauge.functions import rules as R
from tablegauge.functions.session import local_rows
from tablegauge.operators.checks import TableChecks


def _shown(x: Column) -> Column:
    return x.cast("string")


def _issue(df: DataFrame, kind: str, order: int, position: str | None, col: Column, desc: Column,
           severity: Column, importance: Column | None = None) -> DataFrame:
    place = F.col(position) if position else F.lit(0)
    importance = F.lit("IMPORTANT") if importance is None else importance
    return df.select(
        F.lit(order).alias("block"), place.cast("int").alias("position"), F.lit(kind).alias("type"),
        col.alias("col"), desc.alias("desc"), severity.alias("severity"), importance.alias("importance"),
    )


def issues(checks: TableChecks) -> DataFrame:
    """Every finding with its severity; ``block`` and ``position`` give the report's order."""
    c = F.col
    parts = [
        _issue(checks.missing, "missing", 0, "ordinal", c("col"),
               F.concat(F.lit("Missing values: "), _shown(c("pct")), F.lit("% in "), c("col"),
                        F.lit(" ["), c("importance"), F.lit("]")),
               c("risk"), c("importance")),
        _issue(checks.duplicates.filter("duplicate_pct > 0"), "duplicate", 1, None, F.lit("—"),
               F.concat(_shown(c("duplicate_pct")), F.lit("% duplicate rows")),
               R.duplicate_severity(c("duplicate_pct"))),
        _issue(checks.outliers, "outlier", 2, "ordinal", c("col"),
               F.concat(F.lit("Outliers: "), _shown(c("iqr_count")), F.lit(" in "), c("col")), c("risk")),
        _issue(checks.wrong_types, "wrong_type", 3, "ordinal", c("col"),
               F.concat(F.lit("Type mismatch: "), c("col"), F.lit(" ("), c("current_type"),
                        F.lit(" → "), c("suggested_type"), F.lit(")")),
               F.lit("MEDIUM")),
        _issue(checks.skewness, "skewness", 4, "ordinal", c("col"),
               F.concat(F.lit("Skewed: "), c("col"), F.lit(" (skew="), _shown(c("skewness")), F.lit(")")),
               c("level")),
        _issue(checks.correlation.filter("band = 'high'"), "correlation", 5, "position",
               F.concat(c("col1"), F.lit(" ↔ "), c("col2")),
               F.concat(F.lit("High correlation "), _shown(c("correlation")), F.lit(" between "),
                        c("col1"), F.lit(" and "), c("col2")),
               F.lit("MEDIUM")),
        _issue(checks.negative_invalid, "invalid_value", 6, "ordinal", c("col"),
               F.concat(F.lit("Negative values in "), c("col"), F.lit(" ("), _shown(c("count")), F.lit(" rows)")),
               F.lit("HIGH"), F.lit("CRITICAL")),
    ]
    return reduce(DataFrame.unionByName, parts)


def severity_counts(found: DataFrame) -> DataFrame:
    """Issues per level, levels without issue included, and the total."""
    spark = found.sparkSession
    levels = local_rows(spark, [(s, i) for i, s in enumerate(K.SEVERITIES)], "severity string, rank int")
    counted = found.groupBy("severity").agg(F.count("*").alias("issues"))
    # Four levels at most on both sides.
    joined = levels.join(F.broadcast(counted), "severity", "left")
    n = F.coalesce("issues", F.lit(0))
    total = found.agg(F.count("*").alias("total"))
    return joined.select("severity", "rank", n.alias("issues")).crossJoin(F.broadcast(total)).orderBy("rank")


def score_parts(checks: TableChecks) -> DataFrame:
    """One row: the four unrounded parts and what the bonuses look at."""
    profile = checks.profile
    c = F.col
    weight = F.when(c("importance") == "CRITICAL", 2.5).when(c("importance") == "OPTIONAL", 0.3).otherwise(1.5)
    width = F.greatest(F.count("*"), F.lit(1))
    gaps = F.coalesce(F.sum(c("missing_pct") * weight), F.lit(0.0)) / width
    completeness = profile.columns.agg((30.0 - F.least(gaps * 3, F.lit(30.0))).alias("completeness"))

    outliers = checks.outliers.filter(~c("is_ordinal")).agg(
        F.coalesce(F.sum("iqr_count"), F.lit(0)).alias("outlier_rows"))
    share = F.coalesce(F.try_divide("outlier_rows", F.lit(profile.facts.rows)), F.lit(0.0)) * 100
    validity = outliers.select((20.0 - F.least(share * 1.5, F.lit(15.0))).alias("validity"))

    def capped(df: DataFrame, label: str) -> DataFrame:
        return df.agg(F.least(F.count("*") * 2, F.lit(10)).alias(label))

    types = capped(checks.wrong_types, "types")
    skews = capped(checks.skewness.filter("level = 'HIGH'"), "skews")
    invalid = capped(checks.negative_invalid.unionByName(checks.zero_invalid), "invalid")
    overview = profile.overview.select("duplicate_pct", "missing_pct")

    # One-row results side by side.
    row = overview
    for part in (completeness, validity, types, skews, invalid):
        row = row.crossJoin(F.broadcast(part))
    return row.select(
        "duplicate_pct", "missing_pct", F.greatest(F.lit(0.0), "completeness").alias("completeness"),
        F.greatest(F.lit(0.0), 20.0 - F.least(c("duplicate_pct") * 2.0, F.lit(20.0))).alias("consistency"),
        F.greatest(F.lit(0.0), "validity").alias("validity"),
        F.greatest(F.lit(0.0), 30.0 - c("types") - c("skews") - c("invalid")).alias("usability"),
    )


def score(checks: TableChecks) -> DataFrame:
    """One row: total (cut to an integer, bonuses for no gaps and no duplicates), grade, parts."""
    c = F.col
    bonus = F.when(c("missing_pct") == 0, 5).otherwise(0) + F.when(c("duplicate_pct") == 0, 5).otherwise(0)
    raw = c("completeness") + c("consistency") + c("validity") + c("usability") + bonus
    total = F.floor(F.least(F.lit(100.0), F.greatest(F.lit(0.0), raw))).cast("long")
    return score_parts(checks).select(
        total.alias("total"), R.grade(total).alias("grade"), R.quality_tier(total).alias("tier"),
        *[F.round(p).cast("long").alias(p) for p in ("completeness", "consistency", "validity", "usability")],
    )
