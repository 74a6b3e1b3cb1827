"""Exact selection against sorting, with the sample and finish sizes made small."""

import random

import pytest
from pyspark.sql import functions as F

from tablegauge.operators import quantiles as Q
from tablegauge.operators.ranks import grouped_quantiles, ordered_codes


def reference(values, share):
    ordered = sorted(values)
    place = share * (len(ordered) - 1)
    low = int(place)
    high = min(low + 1, len(ordered) - 1)
    return ordered[low] + (ordered[high] - ordered[low]) * (place - low)


def cases():
    rng = random.Random(7)
    return {
        "uniform": [rng.random() for _ in range(5000)],
        "hot": [3.0] * 2000 + [rng.gauss(0, 100) for _ in range(3000)],
        "two_hot": [1.0] * 2500 + [2.0] * 2500,
        "wild": [rng.choice([1e300, -1e300, 1e-300, float("inf"), float("-inf"), 5.0]) * rng.random() for _ in range(3000)],
        "few": [1.0, 2.0],
        "ordered": [float(i) for i in range(5000)],
    }


@pytest.mark.parametrize("name", list(cases()))
def test_order_statistics_equal_sorting(spark, monkeypatch, name):
    monkeypatch.setattr(Q, "SKETCH_SIZE", 100)
    monkeypatch.setattr(Q, "FINISH_ROWS", 50)
    values = [v for v in cases()[name] if v == v]
    df = spark.createDataFrame([(v,) for v in values] + [(None,)] * 10, "x double").repartition(4)
    ranks = [0, 1, len(values) // 4, len(values) // 2, len(values) - 2, len(values) - 1]
    got = Q.order_statistics(df, {"x": F.col("x")}, {"x": ranks}, {"x": len(values)})
    ordered = sorted(values)
    assert {r: got["x", r] for r in ranks if r >= 0} == {r: ordered[r] for r in ranks if r >= 0}


def test_column_quantiles_interpolate(spark, monkeypatch):
    monkeypatch.setattr(Q, "SKETCH_SIZE", 200)
    monkeypatch.setattr(Q, "FINISH_ROWS", 100)
    data = {k: v for k, v in cases().items() if k in ("uniform", "ordered", "two_hot")}
    rows = list(zip(*data.values()))
    df = spark.createDataFrame(rows, ", ".join(f"{k} double" for k in data))
    got = Q.column_quantiles(df, list(data), [0.25, 0.5, 0.75])
    for k, values in data.items():
        assert got[k] == pytest.approx([reference(values, p) for p in (0.25, 0.5, 0.75)], rel=1e-12)


def test_empty_column_has_no_quantile(spark):
    df = spark.createDataFrame([(None,)], "x double")
    assert Q.column_quantiles(df, ["x"], [0.5]) == {"x": [None]}


def test_grouped_quantiles_with_a_hot_group(spark):
    rng = random.Random(3)
    rows = [("hot", rng.gauss(0, 1)) for _ in range(4000)] + [(f"g{i % 7}", float(i % 50)) for i in range(700)] + [("one", 5.0)]
    df = spark.createDataFrame(rows, "g string, x double").repartition(4)
    got = {r["g"]: r for r in grouped_quantiles(df, ["g"], "x", {"q1": 0.25, "q3": 0.75}).collect()}
    groups = {}
    for g, x in rows:
        groups.setdefault(g, []).append(x)
    assert set(got) == set(groups)
    for g, values in groups.items():
        assert got[g]["n"] == len(values)
        assert got[g]["q1"] == pytest.approx(reference(values, 0.25)) and got[g]["q3"] == pytest.approx(reference(values, 0.75))


def test_ordered_codes(spark):
    df = spark.createDataFrame([(v,) for v in ("b", "a", "c", "a", None)], "x string")
    assert {r["value"]: r["code"] for r in ordered_codes(df, "x").collect()} == {"a": 0, "b": 1, "c": 2}


@pytest.mark.parametrize("name", list(cases()))
def test_sketches_are_near_in_rank(spark, monkeypatch, name):
    monkeypatch.setattr(Q, "SKETCH_SIZE", 300)
    values = sorted(v for v in cases()[name] if v == v)
    df = spark.createDataFrame([(v, None) for v in values] + [(None, None), (float("nan"), None)], "x double, e double").repartition(5)
    shares = [0.0, 0.25, 0.5, 0.9, 1.0]
    got = Q.sketched_quantiles(df, {"x": F.col("x"), "e": F.col("e")}, shares)
    assert got["e"] == [None] * len(shares)
    for share, v in zip(shares, got["x"]):
        below, upto = sum(w < v for w in values) / len(values), sum(w <= v for w in values) / len(values)
        assert below - Q.rank_error(300) <= share <= upto + Q.rank_error(300), (share, v)
    assert Q.sketched_quantiles(df, {}, shares) == {}


def test_rows_are_read_three_times_however_many_rounds_follow(spark, monkeypatch):
    monkeypatch.setattr(Q, "SKETCH_SIZE", 100)
    monkeypatch.setattr(Q, "FINISH_ROWS", 10)
    seen = spark.sparkContext.accumulator(0)

    def watched(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    n = 4000
    df = spark.range(n).selectExpr("cast(id * 7 % 4001 as double) as x").mapInArrow(watched, "x double")
    got = Q.quantiles(df, {"x": F.col("x")}, [0.25, 0.5, 0.75], {"x": n})
    assert got["x"] == pytest.approx([reference([i * 7 % 4001 for i in range(n)], p) for p in (0.25, 0.5, 0.75)])
    assert seen.value <= 3 * n


def test_a_computed_column_is_not_computed_for_each_end_of_an_interval(spark):
    df = spark.range(10).selectExpr("case when not isnan(sqrt(id)) then sqrt(id) + 0.0D end as x")
    hunts = [Q._Hunt("x", 1, 0.5, 1.5), Q._Hunt("x", 4, 1.5, 2.5)]
    cells = Q._cells(df, {"x": F.col("x")}, hunts)
    assert sorted(r["value"] for r in cells.collect()) == pytest.approx([1.0, 2**0.5, 3**0.5, 2.0, 5**0.5, 6**0.5])
    plan = cells._jdf.queryExecution().optimizedPlan().toString().lower()
    assert plan.count("sqrt(") <= 2
