"""Distinct numbers and copies of rows, collapsed in runs before the shuffle."""

import datetime
import random

from pyspark.sql import functions as F

from tablegauge.operators import collapse as L
from tablegauge.operators import distinct as D
from tablegauge.operators.duplicates import duplicate_count


def _counts(df, **known):
    return {r["column_name"]: r["n_distinct"] for part in D.distinct_parts(df, **known) for r in part.collect()}


def test_numbers_of_all_kinds_are_counted_as_spark_groups_them(spark, monkeypatch):
    rng = random.Random(3)
    nan, day = float("nan"), datetime.date(1969, 12, 31)
    rows = [(rng.choice([None, 0.0, -0.0, nan, -nan, float("inf"), 1.5]), rng.choice([None, 2**63 - 1, -2**63, 0]), i if i % 3 else None,
             rng.choice([None, True, False]), day + datetime.timedelta(days=i % 5), None, rng.choice([0.5, None, nan]), f"t{i % 4}")
            for i in range(4000)]
    df = spark.createDataFrame(rows, "a double, b bigint, `c.d` int, e boolean, f date, g double, h float, i string").repartition(3)
    expected = {"a": 4, "b": 3, "c.d": 2666, "e": 2, "f": 5, "h": 2, "i": 4}
    assert _counts(df) == _counts(df, values=28_000) == expected
    monkeypatch.setattr(L, "RUN_VALUES", 70)  # runs that are sent, and runs that stay
    monkeypatch.setattr(L, "PART_VALUES", 1000)
    assert _counts(df, values=28_000) == expected


def test_copies_of_rows_in_short_runs(spark, monkeypatch):
    monkeypatch.setattr(L, "RUN_VALUES", 64)
    rows = [(i % 700, None if i % 2 else i % 7) for i in range(3000)] + [(None, None)] * 500
    df = spark.createDataFrame(rows, "a int, b int").repartition(4)
    assert duplicate_count(df).first()[0] == 3500 - df.distinct().count()
    assert duplicate_count(df.limit(0)).first()[0] == 0
    same = spark.createDataFrame([(1, 2), (1, 3), (1, 2), (2, 2)], "a long, b long")
    assert {(r["a"], r["b"]): r["copies"] for r in L.pair_copies(same).collect()} == {(1, 2): 2, (1, 3): 1, (2, 2): 1}


def test_no_map_of_all_values_before_the_shuffle(spark):
    df = spark.range(100).select("id", (F.col("id") * 0.5).alias("x"))
    for counted in (*D.distinct_parts(df), duplicate_count(df)):
        plan = counted._jdf.queryExecution().executedPlan().toString()
        below = plan[plan.rindex("hashpartitioning("):]
        assert "MapInArrow" in below and "HashAggregate" not in below
