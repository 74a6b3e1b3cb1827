"""Probes and counts of the profile that follow the different values, or batches, instead of single rows."""

import random

import pytest
from pyspark.sql import functions as F

from tablegauge.operators import facts as A
from tablegauge.operators import quantiles as Q


@pytest.fixture(scope="module")
def texts(spark):
    n = F.col("id")
    day = F.date_format(F.date_add(F.lit("2020-01-01").cast("date"), (n % 300).cast("int")), "yyyy-MM-dd")
    long = F.concat(F.repeat(F.lit(" "), 70), (n % 9).cast("string"))
    return spark.range(0, 5000, 1, 6).select(
        day.alias("a"), F.when(n % 4 > 0, (n % 7).cast("string")).alias("b"), F.when(n == 4999, "x").otherwise((n % 7).cast("string")).alias("c"),
        F.when(n % 300 == 299, "2020-13-45").otherwise(day).alias("d"), long.alias("e"), F.lit(None).cast("string").alias("f"), n.alias("g"))


def test_short_texts_are_probed_by_their_different_values(texts, monkeypatch):
    tried, one = [], A._probe_pass
    monkeypatch.setattr(A, "_probe_pass", lambda flat, chosen: tried.extend(c.name for c in chosen) or one(flat, chosen))
    found = {c.name: c.suggested for c in A.collect_facts(texts, quartiles=False).columns}
    assert found == {"a": "datetime", "b": "numeric", "c": "", "d": "", "e": "numeric", "f": "", "g": ""}
    assert tried == ["e"]  # the rows are only read for texts that are counted by a digest


@pytest.mark.parametrize("how", ["exact", "approx", "skip"])
def test_the_same_is_suggested_whatever_is_counted(texts, how):
    found = [c.suggested for c in A.collect_facts(texts, distinct=how, quartiles=False).columns]
    assert found == ["datetime", "numeric", "", "", "numeric", "", ""]


def test_rows_below_pivots_of_columns_and_of_slots(spark):
    rng = random.Random(5)
    cells = [[rng.choice([None, -1.0, 0.0, float("inf"), rng.gauss(0, 3)]) for _ in range(2)] for _ in range(3000)]
    rows = spark.createDataFrame(cells, "`0` double, `1` double").repartition(4)
    known = {0: {-1.0, 0.0, 2.5}, 1: {float("inf"), -9.0}}
    wide = Q._rows_below(rows, known)
    assert wide == Q._rows_below(rows.unpivot([], ["0", "1"], "slot", "value").dropna(), known)
    assert wide == {(i, v): (sum(r[i] is not None and r[i] < v for r in cells), sum(r[i] is not None and r[i] <= v for r in cells))
                    for i, values in known.items() for v in values}
