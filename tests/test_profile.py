"""Limits and edge cases of the profile, on hand-worked literals."""

import math

import pytest
from pyspark.sql import functions as F

from tablegauge.functions import names as N
from tablegauge.functions import probes
from tablegauge.functions.nulls import json_safe_values, normalize_nulls
from tablegauge.operators.duplicates import duplicate_count, duplicate_rows
from tablegauge.operators.profile import column_profile, complete_rows, distinct_by_column, missing_cells, profile_table


def rows_by_name(df):
    return {r["name"]: r.asDict() for r in df.collect()}


def test_empty_table_has_no_profile_and_divides_by_nothing(spark):
    df = spark.createDataFrame([], "a long, b string")
    p = profile_table(df)
    assert p.columns.count() == 0 and p.overview.count() == 0
    assert missing_cells(df).first().asDict() == {"missing_cells": 0, "total_cells": 0, "missing_pct": 0.0}
    assert complete_rows(df).first()["complete_rows_pct"] == 0.0
    assert duplicate_rows(df).first().asDict() == {"rows": 0, "duplicate_rows": 0, "duplicate_pct": 0.0}


def test_one_row_has_no_statistics(spark):
    got = rows_by_name(column_profile(spark.createDataFrame([(1.5, "x")], "a double, b string")))
    assert got["a"]["mean"] is None and got["a"]["outliers_iqr"] is None and got["a"]["is_constant"]
    assert got["b"]["top_value"] == "x" and got["b"]["top_freq_pct"] == 100.0


def test_all_null_columns_are_constant_and_fully_missing(spark):
    got = rows_by_name(column_profile(spark.createDataFrame([(None, None)] * 3, "a double, b string")))
    for c in "ab":
        assert got[c]["missing"] == 3 and got[c]["missing_pct"] == 100.0
        assert got[c]["unique"] == 0 and got[c]["is_constant"]
    assert got["b"]["top_value"] is None


def test_constant_column_has_no_shape(spark):
    got = rows_by_name(column_profile(spark.createDataFrame([(0.1,)] * 7, "a double")))["a"]
    assert got["std"] == 0.0 and got["skewness"] is None and got["kurtosis"] is None
    assert got["outliers_iqr"] == 0 and got["outliers_zscore"] == 0 and got["cv"] == 0.0


def test_nan_counts_as_missing_and_infinity_is_not_shown(spark):
    df = spark.createDataFrame([(float("nan"),), (float("inf"),), (None,), (-0.0,), (0.0,), (2.0,)], "a double")
    got = rows_by_name(column_profile(df))["a"]
    assert got["missing"] == 2 and got["unique"] == 3
    assert got["max"] is None and got["min"] == 0.0
    assert normalize_nulls(df).filter("a is null").count() == 2
    assert json_safe_values(df).filter("a is null").count() == 3


def test_json_safe_values_reach_nested_fields(spark):
    df = spark.range(1).select(
        F.struct(F.lit(float("nan")).alias("x"), F.array(F.lit(1.0), F.lit(float("inf"))).alias("y")).alias("s"),
        F.create_map(F.lit("k"), F.lit(float("-inf"))).alias("m"))
    r = json_safe_values(df).first()
    assert r["s"]["x"] is None and r["s"]["y"] == [1.0, None] and r["m"] == {"k": None}


@pytest.mark.parametrize("distinct,ordinal", [(10, True), (11, False)])
def test_ordinal_limit_switches_outliers_off(spark, distinct, ordinal):
    values = [i % (distinct - 1) for i in range(200)] + [1000]
    got = rows_by_name(column_profile(spark.createDataFrame([(v,) for v in values], "x int")))["x"]
    assert got["unique"] == distinct and got["is_ordinal"] is ordinal
    assert (got["outliers_iqr"], got["outliers_zscore"]) == ((0, 0) if ordinal else (1, 1))


@pytest.mark.parametrize("distinct,expected", [(85, False), (86, True)])
def test_id_ratio_is_strict(spark, distinct, expected):
    df = spark.createDataFrame([(f"v{min(i, distinct - 1)}",) for i in range(100)], "x string")
    assert rows_by_name(column_profile(df))["x"]["is_id_like"] is expected


def test_moments_and_quartiles_of_a_small_column(spark):
    got = rows_by_name(column_profile(spark.createDataFrame([(v,) for v in (1.0, 2.0, 10.0, 20.0)], "x double")))["x"]
    assert (got["q25"], got["median"], got["q75"], got["mean"]) == (1.75, 6.0, 12.5, 8.25)
    mean, n = 8.25, 4
    m2, m3, m4 = (sum((v - mean) ** k for v in (1, 2, 10, 20)) / n for k in (2, 3, 4))
    assert got["std"] == round(math.sqrt(m2 * n / (n - 1)), 4)
    assert got["skewness"] == pytest.approx(m3 / m2**1.5, abs=1e-4)
    assert got["kurtosis"] == pytest.approx(m4 / m2**2 - 3, abs=1e-4)


def test_top_value_ties_go_to_the_smallest_and_long_texts_are_whole(spark):
    long = ["z" * 100, "a" * 99 + "2", "a" * 99 + "1"]
    df = spark.createDataFrame([(long[0], "b"), (long[0], "a"), (long[1], "a"), (long[1], "b"), (long[2], None)], "t string, s string")
    got = rows_by_name(column_profile(df))
    assert got["s"]["top_value"] == "a" and got["s"]["top_freq"] == 2
    assert got["t"]["top_value"] == long[1] and got["t"]["unique"] == 3
    unique = spark.createDataFrame([(t,) for t in long], "t string")
    assert rows_by_name(column_profile(unique))["t"]["top_value"] == long[2]


def test_duplicates_treat_nulls_and_nans_as_equal(spark):
    nan = float("nan")
    df = spark.createDataFrame([(1.0, None), (1.0, None), (nan, "x"), (None, "x"), (None, "y")], "a double, b string")
    assert duplicate_count(df).first()[0] == 2


def test_hash_equal_rows_that_differ_are_not_duplicates(spark):
    # A null leaves the running hash as it is, so these two rows share their hash.
    df = spark.createDataFrame([(1, None), (None, 1)], "a long, b long")
    assert df.select(F.xxhash64("a", "b")).distinct().count() == 1
    assert duplicate_count(df).first()[0] == 0


def test_nested_columns_are_compared_by_content(spark):
    df = spark.createDataFrame([([1, 2], {"a": 1}), ([1, 2], {"a": 1}), ([2, 1], {"a": 1})], "x array<int>, m map<string,int>")
    assert duplicate_count(df).first()[0] == 1
    assert {r["name"]: r["unique"] for r in distinct_by_column(df).collect()} == {"x": 2, "m": 1}


@pytest.mark.parametrize("values,expected", [
    (["2020-01-31", "1999-12-01"], "datetime"), (["2020-01-31 10:00:00", "2020-02-01 11:30:00"], "datetime"),
    (["2020-01-31T10:00:00", "2020-02-01T11:30:00Z"], "datetime"), (["01/31/2024", "02/01/2024"], "datetime"),
    (["31/01/2024", "01/02/2024"], "datetime"), (["20240101", "20241231"], "datetime"),
    (["Mar 3 2020", "Dec 24 2021"], "datetime"), (["2020", "1999"], "datetime"), (["10:30", "23:59"], "datetime"),
    (["2020-01-31", "01/31/2024"], ""), (["2020-13-31", "2020-01-01"], ""), (["1.5", "1e3", " 3 "], "numeric"),
    (["1", "35"], "numeric"), (["1d", "2"], ""), (["1,234", "5"], ""), (["$5", "6"], ""), (["May", "June"], ""),
])
def test_probes(spark, values, expected):
    df = spark.createDataFrame([(v,) for v in values] + [(None,)], "field string")
    assert rows_by_name(column_profile(df))["field"]["suggested_dtype"] == expected


def test_number_probe_respects_a_date_like_name(spark):
    df = spark.createDataFrame([("1",), ("2",)], "created_at string")
    assert rows_by_name(column_profile(df))["created_at"]["suggested_dtype"] == ""


def test_name_classifiers(spark):
    cases = spark.createDataFrame(
        [("width",), ("Review-Text",), ("user id",), ("shape",), ("created_at",), ("update",), ("price",)], "n string")
    got = {r[0]: r for r in cases.select(
        "n", N.column_importance(F.col("n"), "shape"), N.name_is_id_like(F.col("n")), N.name_suggests_datetime(F.col("n"))).collect()}
    assert got["width"][1] == "CRITICAL" and got["Review-Text"][1] == "OPTIONAL" and got["shape"][1] == "CRITICAL"
    assert got["user id"][2] and not got["width"][2]
    assert got["created_at"][3] and not got["update"][3]


def test_resolve_target(spark):
    df = spark.createDataFrame([], "`Label ` string, b int")
    assert N.resolve_target(df, "label") == "Label "
    with pytest.raises(KeyError):
        N.resolve_target(df, "c")


def test_parse_number_and_dates_give_null_for_the_rest(spark):
    df = spark.createDataFrame([("1.5",), ("1d",), ("2020-02-30",)], "t string")
    assert [r[0] for r in df.select(probes.parse_number(F.col("t"))).collect()] == [1.5, None, None]
    assert df.select(probes.parse_datetime_any(F.col("t")).alias("d")).filter("d is not null").count() == 0


def test_repeated_rows_are_listed_with_their_copies(spark):
    from tablegauge.operators.duplicates import duplicate_groups

    df = spark.createDataFrame([(1, None), (None, 1), (1, None), (2, 2)], "a long, b long")
    assert [tuple(r) for r in duplicate_groups(df).collect()] == [(1, None, 2)]


def test_duplicates_per_key(spark):
    df = spark.createDataFrame([("x", 1), ("x", 1), ("x", 1), ("y", 1)], "k string, a long")
    assert {r["k"]: r["duplicate_rows"] for r in duplicate_count(df, ["k"]).collect()} == {"x": 2, "y": 0}


def test_sketched_distinct_counts_are_close(spark):
    df = spark.range(20_000).select(F.col("id").alias("a"), (F.col("id") % 7).alias("b"), F.lit(None).cast("long").alias("c"))
    facts = profile_table(df, distinct="approx", quartiles=False, duplicates=False).facts
    assert abs(facts["a"].distinct - 20_000) < 2_000 and facts["b"].distinct == 7 and facts["c"].distinct == 0


def test_large_inputs_are_read_again_with_the_same_result(spark, monkeypatch):
    import tablegauge.functions.session as session

    df = spark.range(500).select((F.col("id") % 50 * 1.5).alias("x"), (F.col("id") % 3).cast("string").alias("y"))
    kept = [tuple(r) for r in column_profile(df).collect()]
    monkeypatch.setattr(session.staged.__wrapped__, "__defaults__", (0,))
    assert [tuple(r) for r in column_profile(df).collect()] == kept


def test_formats_that_the_ends_do_not_follow_are_not_tried_per_row(spark, monkeypatch):
    from tablegauge.operators import facts

    tried, plain = [], facts.parse_datetime

    def watched(text, fmt, pattern):
        tried.append((str(text), fmt))
        return plain(text, fmt, pattern)

    monkeypatch.setattr(facts, "parse_datetime", watched)
    rows = [("2024-01-0%d" % i, "n%d" % i, "1.%d" % i, "12:0%d" % i if i != 5 else "x") for i in range(1, 9)] + [(None,) * 4]
    df = spark.createDataFrame(rows, "made string, note string, price string, clock string")
    found = facts.collect_facts(df, distinct="skip", quartiles=False)
    assert [c.suggested for c in found.columns] == ["datetime", "", "numeric", ""]
    assert {fmt for text, fmt in tried if "note" in text or "price" in text} == set()
    assert {fmt for text, fmt in tried if "made" in text} == {"yyyy-MM-dd"}
