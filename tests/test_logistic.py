"""The baseline's coefficients: the same optimum as the library's own solver, in a few passes."""

import random

import numpy as np
import pytest
from pyspark.ml.classification import LogisticRegression
from pyspark.sql import functions as F

from tablegauge.operators import learn as N
from tablegauge.operators import logistic as L


def _rows(spark, classes, parts=5):
    """Classes that overlap on ``a`` and ``b``; the last one is told apart by ``c``, and ``k`` never varies."""
    rng = random.Random(3)
    rows = [(float(i % classes), rng.gauss(i % classes, 2.0), rng.gauss(0, 1), float(i % classes == classes - 1), 0.0) for i in range(900)]
    return spark.createDataFrame(rows, "label double, a double, b double, c double, k double").repartition(parts, "a", "b")


def _counts(df):
    return [r["count"] for r in df.groupBy("label").count().orderBy("label").collect()]


@pytest.mark.parametrize("classes", [2, 4])
@pytest.mark.parametrize("merge", [1, 1 << 25])
def test_same_optimum_as_the_slow_solver(spark, monkeypatch, classes, merge):
    monkeypatch.setattr(L, "_MERGE_BYTES", merge)
    df, names = _rows(spark, classes), ["a", "b", "c", "k"]
    w = L.newton(df, names, "label", _counts(df), 1 / 900)
    model = LogisticRegression(maxIter=3000, tol=1e-14, regParam=1 / 900, standardization=False).fit(N._vector(df, names))
    slow = np.column_stack([model.coefficientMatrix.toArray(), model.interceptVector.toArray()])
    if classes > 2:  # one number added to all intercepts changes nothing
        slow[:, -1] -= slow[:, -1].mean()
        w[:, -1] -= w[:, -1].mean()
    assert w == pytest.approx(slow, abs=2e-3)
    told = L.predicted(df, names, w).select("label", "prediction").collect()
    assert {r["prediction"] for r in told} <= set(map(float, range(classes)))
    assert all((r["label"] == classes - 1) == (r["prediction"] == classes - 1) for r in told)


def test_few_passes_over_classes_that_can_be_told_apart(spark, monkeypatch):
    """The library's own solver took 500 and more passes over such rows."""
    passes, one = [], L._pass
    monkeypatch.setattr(L, "_pass", lambda *a: passes.append(1) or one(*a))
    rows = spark.range(0, 4000, 1, 3).select(
        (F.col("id") % 50).cast("double").alias("a"), (F.col("id") % 3 == 0).alias("b"), F.col("id").alias("key"),
        F.when(F.col("id") % 3 == 0, F.when(F.col("id") % 50 > 25, "large").otherwise("small")).otherwise(F.concat(F.lit("x"), F.col("id") * 7919 % 3)).alias("target"))
    scored = N.scored_baseline(rows, "target", carry=["key"])
    assert 3 < len(passes) <= 40
    sure = scored.join(rows.select("key", "target"), "key").filter("target in ('large', 'small')")
    assert sure.agg(F.avg((F.col("label") == F.col("prediction")).cast("int"))).first()[0] > 0.95


def test_odd_tables_are_left_to_the_other_solver(spark):
    df = spark.createDataFrame([(0.0, 1.0, float("inf")), (1.0, 2.0, 1.0), (2.0, None, 1.0)] * 9, "label double, a double, b double")
    assert L.newton(df, ["a"], "label", [9, 9, 9], 0.1) is None
    assert L.newton(df, ["b"], "label", [9, 9, 9], 0.1) is None
    assert L.newton(df, ["b"], "label", [9, 0, 18], 0.1) is None
    assert L.newton(df, ["b"] * L.MOST_COEFFICIENTS, "label", [9, 18], 0.1) is None
