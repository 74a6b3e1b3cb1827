"""Datasets with few rows are packed, those with many are not; both give the same numbers, and little is written."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from tablegauge.functions.session import shared_dir, written
from tablegauge.operators import learn as N
from tablegauge.operators import meta as M
from tablegauge.operators import packed as P


def odd(spark, n=900):
    i = F.col("id")
    rows = spark.range(n).select(
        F.when(i % 9 > 0, F.concat(F.lit("s"), (i % 4).cast("string"))).alias("g"), F.when(i % 5 > 0, (i % 2).cast("int")).alias("h"),
        F.when(i % 7 > 0, ((i * 7919) % 101) / 3).otherwise(F.lit(float("nan"))).alias("a"), F.when(i % 11 > 0, (i * i) % 37).alias("b"),
        F.lit(4.0).alias("c"), F.lit(None).cast("double").alias("void"), (i % 13 == 0).alias("flag"),
        F.when(i % 3 > 0, F.concat(F.lit("t"), (i % 6).cast("string"))).alias("t"), ((i % 8) / 4).cast("decimal(9,3)").alias("d"),
        F.when(i % 100 == 1, 1e9).otherwise((i % 3) * 1.0).alias("out"), F.when(i % 10 > 0, F.array(i % 2)).alias("list"),
        F.when(i % 17 > 0, (i % 3).cast("string")).alias("target"))
    return rows.unionByName(rows.where("a > 20")).unionByName(spark.createDataFrame([("lone", 1, 2.0, "x")], "g string, h int, a double, target string"), allowMissingColumns=True)


def test_packed_or_not_the_numbers_are_the_same(spark, monkeypatch):
    df = odd(spark)
    monkeypatch.setattr(P, "CHUNK_ROWS", 200)
    monkeypatch.setattr(P, "BUCKET_ROWS", 300)
    monkeypatch.setattr(P, "_AT_ONCE", 50)
    for keys, most in ((["g"], 0), (["g", "h"], 40)):
        monkeypatch.setattr(P, "FEW_ROWS", 1 << 18)
        few = {tuple(r[k] for k in keys): r.asDict() for r in M.meta_features_by(df, keys, "target").collect()}
        monkeypatch.setattr(P, "FEW_ROWS", most)
        many = {tuple(r[k] for k in keys): r.asDict() for r in M.meta_features_by(df, keys, "target").collect()}
        assert few.keys() == many.keys() and len(few) > 4
        for key, row in few.items():
            for name, value in many[key].items():
                assert row[name] == (pytest.approx(value, abs=2e-4, rel=1e-9) if isinstance(value, float) else value), (key, name)
    assert any(r["outlier_pct"] > 0 for r in few.values()) and any(r["duplicate_pct"] > 0 for r in few.values())


def stored(spark):
    return sum(os.stat(os.path.join(at, f)).st_size for at, _, files in os.walk(shared_dir(spark).removeprefix("file:")) for f in files)


def test_little_is_written_for_many_datasets(spark):
    """A checkpoint of all rows or of all values takes some hundred bytes for each."""
    n = 60_000
    i = F.col("id")
    df = spark.range(n).select((i % 50).alias("g"), ((i * 7919) % 10007).cast("double").alias("a"), (i % 11).cast("double").alias("b"),
                               (i % 7).cast("double").alias("c"), F.when((i * 31) % 101 > 50, "x").otherwise("y").alias("target"))
    before = stored(spark)
    assert len(M.meta_features_by(df, ["g"], "target").collect()) == 50
    features, at = stored(spark) - before, stored(spark)
    assert features < 2 * n
    assert N.scored_baseline(df, "target", carry=["g"]).count() == n
    assert stored(spark) - at < 40 * n


def test_written_rows_are_the_same(spark):
    rows = spark.range(50).select(F.col("id").alias("A"), F.col("id").cast("string").alias("a"), F.array("id").alias("x y"), F.col("id").alias("label", metadata={"k": 1}))
    got = written(rows, "same")
    assert got.columns == ["A", "a", "x y", "label"] and got.schema["label"].metadata == {"k": 1}
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, rows.collect()))
    assert written(rows.select(F.lit(None).alias("void")), "same").count() == 50


def test_infinite_values_stay_as_they_were(spark, monkeypatch):
    rows = [("a", float(x), "u") for x in [1, 2, 3, np.inf, np.inf, np.inf, -np.inf, 4]] + [("b", 1.0, "u"), ("b", np.inf, None)]
    df = spark.createDataFrame(rows, "g string, x double, target string")
    few = sorted(map(tuple, M.meta_features_by(df, ["g"], "target").collect()))
    monkeypatch.setattr(P, "FEW_ROWS", 0)
    assert few == sorted(map(tuple, M.meta_features_by(df, ["g"], "target").collect()))
