"""Rule ladders exactly at their limits, checks, score and recommendations."""

import pytest
from pyspark.sql import functions as F

from tablegauge.functions import rules as R
from tablegauge.operators import checks as C
from tablegauge.operators import distributions as X
from tablegauge.operators import recommend as M
from tablegauge.operators import score as Z
from tablegauge.operators.readiness import Readiness, class_imbalance, suggest_targets, task_type
from tablegauge.plans.analyze import analyze


def value(spark, expr):
    return spark.range(1).select(expr.alias("v")).first()["v"]


@pytest.mark.parametrize("pct,importance,expected", [
    (0.0, "CRITICAL", "LOW"), (0.01, "CRITICAL", "HIGH"), (5.0, "CRITICAL", "HIGH"), (5.01, "CRITICAL", "CRITICAL"),
    (80.0, "OPTIONAL", "LOW"), (80.01, "OPTIONAL", "MEDIUM"), (20.0, "IMPORTANT", "LOW"),
    (20.01, "IMPORTANT", "MEDIUM"), (50.0, "IMPORTANT", "MEDIUM"), (50.01, "IMPORTANT", "HIGH"),
])
def test_missing_risk(spark, pct, importance, expected):
    assert value(spark, R.missing_risk(F.lit(pct), F.lit(importance))) == expected


@pytest.mark.parametrize("pct,check,issue", [
    (2.0, "LOW", "LOW"), (2.01, "LOW", "MEDIUM"), (5.0, "LOW", "MEDIUM"), (5.01, "MEDIUM", "MEDIUM"),
    (10.0, "MEDIUM", "MEDIUM"), (10.01, "MEDIUM", "HIGH"), (20.0, "MEDIUM", "HIGH"), (20.01, "HIGH", "HIGH"),
])
def test_duplicate_limits(spark, pct, check, issue):
    assert value(spark, R.duplicate_risk(F.lit(pct))) == check
    assert value(spark, R.duplicate_severity(F.lit(pct))) == issue


@pytest.mark.parametrize("dominant,expected", [(70, "LOW"), (71, "MEDIUM"), (80, "MEDIUM"), (81, "HIGH"), (90, "HIGH"), (91, "CRITICAL")])
def test_class_limits(spark, dominant, expected):
    df = spark.createDataFrame([("a",)] * dominant + [("b",)] * (100 - dominant) + [(None,)] * 5, "y string")
    got = class_imbalance(df, "y").first()
    assert got["risk"] == expected and got["dominant_pct"] == dominant and got["minority_pct"] == 100 - dominant


def test_single_and_missing_classes(spark):
    one = class_imbalance(spark.createDataFrame([("a",)], "y string"), "y").first()
    assert one["dominant_pct"] == one["minority_pct"] == 100.0
    none = class_imbalance(spark.createDataFrame([(None,)], "y string"), "y").first()
    assert none["dominant_class"] is None and none["dominant_pct"] is None


@pytest.mark.parametrize("args,expected", [
    ((0.9, 0.7, 0.2, 5000, 0.5, 0.0), "Overfitting Risk"), ((0.9, 0.85, 0.05, 999, 0.86, 0.0), "Overfitting Risk"),
    ((0.9, 0.85, 0.05, 1000, 0.86, 0.0), "Safe Dataset"), ((0.5, 0.5, 0.0, 5000, 0.5, 0.0), "Underfitting Risk"),
    ((0.9, 0.9, 0.0, 99, 0.5, 0.0), "Underfitting Risk"), ((0.9, 0.9, 0.0, 100, 0.5, 0.31), "Underfitting Risk"),
    ((0.9, 0.9, 0.15, None, None, None), "Safe Dataset"),
])
def test_risk_label(spark, args, expected):
    kinds = ("double", "double", "double", "long", "double", "double")
    assert value(spark, R.risk_label(*[F.lit(a).cast(k) for a, k in zip(args, kinds)])) == expected


@pytest.mark.parametrize("total,grade,tier", [(90, "Excellent", "Good"), (89, "Good", "Good"), (74, "Good", "Fair"),
                                              (69, "Needs Cleaning", "Fair"), (49, "High Risk", "Poor")])
def test_grades(spark, total, grade, tier):
    assert value(spark, R.grade(F.lit(total))) == grade and value(spark, R.quality_tier(F.lit(total))) == tier


def test_clean_table_scores_one_hundred(spark):
    df = spark.range(200).select((F.col("id") * 3).alias("k"), (F.col("id") % 50).alias("m"))
    checks = C.check_table(df)
    got = Z.score(checks).first()
    assert got["total"] == 100 and got["grade"] == "Excellent"
    assert [r["issues"] for r in Z.severity_counts(Z.issues(checks)).collect()] == [0, 0, 0, 0]
    assert [r["title"] for r in M.recommendations(checks).collect()] == [M.TEXTS["scaling"][1]]


def test_score_stays_between_limits(spark):
    df = spark.range(60).select(
        F.lit(None).cast("double").alias("price"), F.lit(None).cast("string").alias("label"),
        F.when(F.col("id") > 58, 1e6).otherwise(-(F.col("id") % 12)).alias("weight"))
    got = Z.score(C.check_table(df)).first()
    assert 0 <= got["total"] <= 100 and got["completeness"] == 0 and got["validity"] >= 5


def test_correlation_of_constants_and_gaps(spark):
    df = spark.createDataFrame([(float(i), 2.0 * i, 1.0, None if i % 2 else float(-i)) for i in range(40)],
                               "a double, b double, c double, d double")
    found = {(r["col1"], r["col2"]): r["r"] for r in C.correlation_pairs(df, C.check_table(df).profile).collect()}
    assert found[("a", "b")] == pytest.approx(1.0) and found[("a", "d")] == pytest.approx(-1.0)
    assert not any("c" in k for k in found)


@pytest.mark.parametrize("low,high,first", [(0.0, 8.0, -0.008), (5.0, 5.0, 4.995), (0.0, 0.0, -0.001)])
def test_bin_edges(low, high, first):
    edges = X.bin_edges(low, high)
    assert edges[0] == pytest.approx(first) and len(edges) == 9 and edges[-1] >= high


def test_histogram_bins_are_right_closed_and_complete(spark):
    df = spark.createDataFrame([(float(v),) for v in [0, 1, 1, 2, 4, 8]] + [(None,)], "v double")
    facts = C.check_table(df).profile.facts
    counts = [r["count"] for r in X.histogram(df, facts, ["v"]).orderBy("bin").collect()]
    assert counts == [3, 1, 0, 1, 0, 0, 0, 1] and sum(counts) == 6


def test_suggested_targets_and_task(spark):
    df = spark.range(100).select(
        F.col("id").alias("row_id"), (F.col("id") % 3).alias("label"), (F.col("id") % 60).alias("amount"),
        F.concat(F.lit("c"), (F.col("id") % 4).cast("string")).alias("colour"), (F.col("id") % 2 == 0).alias("flag"))
    profile = C.check_table(df).profile
    got = [(r["column"], r["confidence"]) for r in suggest_targets(profile).collect()]
    assert got == [("label", 0.8), ("colour", 0.5), ("flag", 0.3)]
    assert [task_type(profile, c) for c in ("label", "amount", "colour")] == ["classification", "regression", "classification"]
    ready = Readiness(df, profile, "amount")
    assert ready.imbalance is None and ready.target_skewness is not None and ready.constant_features == []


def test_missing_recommendation_takes_the_first_matching_rule(spark):
    n = 100
    df = spark.range(n).select(
        F.when(F.col("id") < 50, F.col("id")).alias("order_id"), F.when(F.col("id") < 95, 1.0).alias("price"),
        F.when(F.col("id") < 5, "x").alias("comment"), F.when(F.col("id") < 60, F.col("id")).alias("shade"),
        F.when(F.col("id") < 97, F.col("id")).alias("tone"))
    got = {r["title"]: r["priority"] for r in M.recommend_missing(C.check_table(df)).collect()}
    assert got == {"Critical key missing: order_id": "HIGH", "Financial column missing: price": "MEDIUM",
                   "Optional field missing: comment": "LOW", "Handle missing values: shade": "HIGH",
                   "Handle missing values: tone": "LOW"}


def test_only_seven_missing_recommendations(spark):
    df = spark.range(10).select(*[F.when(F.col("id") > i % 5, 1).alias(f"c{i}") for i in range(9)])
    assert M.recommend_missing(C.check_table(df)).count() == 7


def test_analysis_with_unknown_target_goes_on(spark):
    report = analyze(spark.range(30).select((F.col("id") % 7).alias("x")), "nope")
    assert report.target_used is None and report.readiness is None
    with pytest.raises(ValueError):
        analyze(spark.range(0).toDF("x"))
