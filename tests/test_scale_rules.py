"""Hot keys, wide correlations and long texts: the paths that small tables do not take by themselves."""

import math
from itertools import combinations

import numpy as np
import pytest
from pyspark.errors import AnalysisException, PySparkException
from pyspark.sql import functions as F

from tablegauge.functions import joins as J
from tablegauge.functions.failures import cannot_read
from tablegauge.operators.correlation import correlations
from tablegauge.operators.distinct import smallest_top_text
from tablegauge.operators.learn import encode_labels
from tablegauge.operators.profile import profile_table
from tablegauge.operators.relate import referential_integrity
from tablegauge.operators.remediate import fix_class_weights


@pytest.fixture
def no_broadcast(spark, monkeypatch):
    """A lookup table counts as large, and nothing is broadcast by itself."""
    monkeypatch.setattr(J, "BROADCAST_BYTES", -1)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def hot_rows(spark):
    """99 % of the rows have one key; some have none, some have one that the lookup lacks."""
    key = F.when(F.col("id") % 100 > 0, "hot").when(F.col("id") % 300 == 0, None).otherwise(F.concat(F.lit("k"), F.col("id") % 7))
    return spark.range(4000).select("id", key.alias("key"))


@pytest.mark.parametrize("how", ["inner", "left"])
def test_hot_key_is_split_from_the_shuffle(spark, no_broadcast, how):
    rows = hot_rows(spark)
    found = spark.createDataFrame([("hot", 1), *[(f"k{i}", 10 + i) for i in range(5)], ("other", 3)], "key string, value int")
    got = J.joined_by_key(rows, found, ["key"], how)
    plain = rows.join(found, "key", how)
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, plain.select(got.columns).collect()), key=str)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" in plan


def test_labels_and_weights_with_a_hot_class(spark, no_broadcast):
    rows = hot_rows(spark)
    codes = {r["key"]: r["n"] for r in encode_labels(rows, ["key"]).groupBy("key").agg(F.count("*").alias("n")).collect()}
    names = sorted({"nan" if r["key"] is None else r["key"] for r in rows.select("key").distinct().collect()})
    assert codes[names.index("hot")] == 3960 and sum(codes.values()) == 4000 and None not in codes
    weights = fix_class_weights(rows, "key")
    assert weights.count() == 4000
    hot = weights.where("key = 'hot'").select("class_weight").distinct().collect()
    assert len(hot) == 1 and 0 < hot[0][0] < 1


def test_correlations_against_numpy(spark):
    own = np.random.default_rng(4)
    x = own.normal(size=(500, 5)) @ own.normal(size=(5, 9)) + 1e6
    x[:, 7] = 5.0
    gaps = own.random(x.shape) < 0.2
    gaps[:, 0] = False
    gaps[:, 8] = own.random(500) < 0.995
    rows = [[None if g else float(v) for v, g in zip(*r)] for r in zip(x, gaps)]
    names = [f"c{i}" for i in range(9)]
    df = spark.createDataFrame(rows, names).repartition(7)
    got = correlations(df, list(combinations(names, 2)))
    for (a, b), r in got.items():
        i, j = names.index(a), names.index(b)
        both = ~gaps[:, i] & ~gaps[:, j]
        p, q = x[both, i], x[both, j]
        if len(p) < 2 or p.min() == p.max() or q.min() == q.max():
            assert r is None
        else:
            assert math.isclose(r, np.corrcoef(p, q)[0, 1], abs_tol=1e-9)
    assert all(r is None for r in correlations(df.limit(0), [("c0", "c1")]).values()) and correlations(df, []) == {}


def test_one_long_value_does_not_hide_a_type(spark):
    rows = [(str(i),) for i in range(30)] + [("1" * 81,)]
    facts = profile_table(spark.createDataFrame(rows, "v string"), quartiles=False, duplicates=False).facts
    assert facts["v"].suggested == "numeric"


def test_uncounted_facts_are_null(spark):
    df = spark.range(100).select((F.col("id") * 1.5).alias("v"))
    row = profile_table(df, distinct="skip", duplicates=False).columns.first()
    assert row["unique"] is None and row["is_constant"] is None and row["is_ordinal"] is None and row["outliers_iqr"] is None
    assert row["mean"] == 74.25


def test_decimal_and_integer_keys_keep_their_digits(spark):
    a = spark.createDataFrame([(1,)], "i int").select(F.expr("cast('9007199254740993' as decimal(20,2))").alias("k"))
    b = spark.createDataFrame([(9007199254740992,)], "k bigint")
    assert not referential_integrity(a, "k", b, "k").first()["integrity_ok"]
    assert referential_integrity(a, "k", b.select(F.col("k") + 1), "(k + 1)").first()["integrity_ok"]
    double = spark.createDataFrame([(3.0,), (4.5,)], "k double")
    assert referential_integrity(spark.createDataFrame([(3,)], "k int"), "k", double, "k").first()["integrity_ok"]


def test_only_read_errors_are_passed_over(spark):
    with pytest.raises(AnalysisException) as lost:
        spark.read.parquet("/no/such/path")
    assert cannot_read(lost.value) and cannot_read(ValueError("small")) and not cannot_read(TypeError("mistake"))
    with pytest.raises(PySparkException) as failed:
        spark.range(1).select(F.raise_error(F.lit("a task failed"))).collect()
    assert not cannot_read(failed.value)


def test_most_frequent_long_text_needs_no_join(spark):
    texts = [c * 200 for c in "dcba"]
    rows = [(t,) for t, n in zip(texts, (5, 900, 900, 1)) for _ in range(n)] + [(None,)] * 2000
    df = spark.createDataFrame(rows, "v string").repartition(6)
    got = smallest_top_text(df, "v", 900)
    assert got.first()["top_value"] == texts[2]
    assert "Join" not in got._jdf.queryExecution().optimizedPlan().toString()
    assert smallest_top_text(df.distinct(), "v", 1).first()["top_value"] == texts[3]
