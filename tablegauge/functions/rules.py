"""The rule ladders, as column expressions. The order of the branches is the rule."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tablegauge.functions import keywords as K


def percent(part: Column, whole: Column, digits: int = 2) -> Column:
    """part / whole as a rounded percentage; 0 for an empty whole."""
    return F.coalesce(F.round(F.try_divide(part, whole) * 100, digits), F.lit(0.0))


def severity_rank(level: Column) -> Column:
    """0 for the worst level, 4 for anything unknown."""
    rank = F.lit(4)
    for i, name in reversed(list(enumerate(K.SEVERITIES))):
        rank = F.when(level == name, F.lit(i)).otherwise(rank)
    return rank


def missing_risk(pct: Column, importance: Column) -> Column:
    critical = importance == "CRITICAL"
    return (
        F.when(critical & (pct > 5), "CRITICAL")
        .when(critical & (pct > 0), "HIGH")
        .when((importance == "OPTIONAL") & (pct > 80), "MEDIUM")
        .when(importance == "OPTIONAL", "LOW")
        .when(pct > 50, "HIGH")
        .when(pct > 20, "MEDIUM")
        .otherwise("LOW")
    )


def outlier_risk(count: Column, n_rows: Column) -> Column:
    pct = F.coalesce(F.try_divide(count, n_rows) * 100, F.lit(0.0))
    return F.when(pct > 15, "HIGH").when(pct > 5, "MEDIUM").otherwise("LOW")


def duplicate_risk(pct: Column) -> Column:
    """Level shown by the duplicate check."""
    return F.when(pct > 20, "HIGH").when(pct > 5, "MEDIUM").otherwise("LOW")


def duplicate_severity(pct: Column) -> Column:
    """Level of the duplicate issue; its limits are stricter than those of the check."""
    return F.when(pct > 10, "HIGH").when(pct > 2, "MEDIUM").otherwise("LOW")


def skew_level(skewness: Column) -> Column:
    size = F.abs(skewness)
    return F.when(size > 2, "HIGH").when(size > 1, "MEDIUM").otherwise("LOW")


def correlation_band(r: Column) -> Column:
    """high, medium, or NULL for a pair that is not reported."""
    size = F.abs(r)
    return F.when(size > 0.9, "high").when(size > 0.7, "medium")


def imbalance_risk(dominant_pct: Column) -> Column:
    return (
        F.when(dominant_pct > 90, "CRITICAL")
        .when(dominant_pct > 80, "HIGH")
        .when(dominant_pct > 70, "MEDIUM")
        .otherwise("LOW")
    )


def grade(total: Column) -> Column:
    return (
        F.when(total >= 90, "Excellent")
        .when(total >= 70, "Good")
        .when(total >= 50, "Needs Cleaning")
        .otherwise("High Risk")
    )


def quality_tier(total: Column) -> Column:
    return F.when(total >= 75, "Good").when(total >= 50, "Fair").otherwise("Poor")


def risk_label(
    train_acc: Column,
    test_acc: Column,
    gap: Column,
    n_samples: Column | None = None,
    imbalance: Column | None = None,
    missing: Column | None = None,
) -> Column:
    """Overfitting / underfitting / safe. An unknown (NULL) input never fires its rule."""
    n = F.lit(None).cast("long") if n_samples is None else n_samples
    share = F.lit(None).cast("double") if imbalance is None else imbalance
    gaps = F.lit(None).cast("double") if missing is None else missing
    return (
        F.when(gap > 0.15, "Overfitting Risk")
        .when((share > 0.85) & (n < 1000), "Overfitting Risk")
        .when((train_acc < 0.60) & (test_acc < 0.60), "Underfitting Risk")
        .when(n < 100, "Underfitting Risk")
        .when(gaps > 0.30, "Underfitting Risk")
        .otherwise("Safe Dataset")
    )


# The labels risk_label can give, in sorted order.
RISK_LABELS = ("Overfitting Risk", "Safe Dataset", "Underfitting Risk")
