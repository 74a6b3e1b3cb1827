"""Hard negatives: against plain search in whole numbers, and intervals that hold every score."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tablegauge.llm import negatives as N
from tablegauge.llm.common import table
from tests.llm.helpers import CLASHES

SCHEMA = "vec_id bigint, embedding array<double>, label int, " + ", ".join(f"`{c}` string" for c in dict.fromkeys([*CLASHES, "size", "code", "grp", "share", "kind", "positives", "vector", "norm"]))


def frame(spark, rows):
    width = len(SCHEMA.split(",")) - 3
    return spark.createDataFrame([(i, v, label, *["x"] * width) for i, v, label in rows], SCHEMA).repartition(3)


def plain(rows, is_anchor, k, m, low, high, scale):
    known = {}
    for i, v, label in rows:
        if i is not None and label is not None and v and all(x is not None and math.isfinite(x) for x in v):
            known[i] = min(known.get(i, (label, v)), (label, v))
    whole = {i: (label, [math.floor(scale * x) if abs(x) < 2.0**60 else int(x) * scale for x in v]) for i, (label, v) in known.items()}
    out = []
    for a, (label, v) in whole.items():
        if not is_anchor(a):
            continue
        scored = sorted((-min(2**63 - 1, max(-2**63, sum(x * y for x, y in zip(v, w)))), i, other) for i, (other, w) in whole.items() if i != a and len(w) == len(v))
        for p, positive, _ in [s for s in scored if s[2] == label][:k]:
            fits = [s for s in scored if s[2] != label and low * -p <= 100 * -s[0] <= high * -p]
            out += [(a, positive, n + 1, i, -p, -s) for n, (s, i, _) in enumerate(fits[:m])]
    return sorted(out)


def vectors(seed, n, size, labels=4):
    own = np.random.default_rng(seed)
    centres = own.standard_normal((labels, size))
    rows = [(i, (centres[i % labels] + own.standard_normal(size) * 0.9).tolist(), int(own.integers(labels))) for i in range(n)]
    return rows


@pytest.mark.parametrize("seed,size,k,m,low,high", [(1, 24, 5, 5, 80, 100), (2, 130, 3, 7, 50, 120), (3, 3, 5, 2, 90, 95)])
@pytest.mark.parametrize("held", [(8_192, 32), (7, 5)])
def test_against_plain_search(spark, monkeypatch, seed, size, k, m, low, high, held):
    monkeypatch.setattr(N, "ANCHORS", held[0])
    monkeypatch.setattr(N, "SHARES", held[1])
    rows = vectors(seed, 500, size)
    rows += [(500 + i, rows[i][1], rows[i][2]) for i in range(0, 60, 3)]  # copies: ties
    got = N.hard_negatives(frame(spark, rows), F.col("vec_id") % 10 == 0, k, m, low, high, 256)
    assert sorted(map(tuple, got.collect())) == plain(rows, lambda i: i % 10 == 0, k, m, low, high, 256)


def test_rows_that_take_no_part_and_odd_ones(spark):
    rows = vectors(4, 80, 6)
    rows += [(None, [1.0] * 6, 1), (100, None, 1), (110, [1.0] * 6, None), (120, [], 1), (130, [1.0, None] * 3, 1), (140, [float("nan")] * 6, 1), (150, [float("inf")] * 6, 1),
             (160, [0.0] * 6, 1), (170, [1e300] * 6, 2), (180, [-1e308, 1e308, 0.0, 0.0, 1.0, 2.0], 1), (190, [2.0**53] * 6, 1), (191, [2.0**40 + 0.5] * 6, 2), (200, [1.0] * 3, 1), (201, [1.0] * 3, 2), (202, [0.9] * 3, 1),
             (10, rows[10][1], rows[10][2]), (20, rows[21][1], 0)]
    got = N.hard_negatives(frame(spark, rows), F.col("vec_id") % 10 == 0)
    assert sorted(map(tuple, got.collect())) == plain(rows, lambda i: i % 10 == 0, 5, 5, 80, 100, 256)


def test_one_label_one_row_and_empty_tables(spark):
    rows = [(i, v, 1) for i, v, _ in vectors(5, 40, 4)]
    for some in (rows, rows[:1], []):
        assert N.hard_negatives(frame(spark, some), F.col("vec_id") % 10 == 0).collect() == []


def test_intervals_hold_every_score_and_leave_most_rows(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.col("label").cast("bigint"), F.col("embedding").cast("array<double>").alias("vector"))
    batch = N.coded(rows, 256).toArrow().combine_chunks().to_batches()[0]
    own = N.Vectors(batch, 256)
    low, high = N.Asked(own).intervals(0, len(own.ids), own, slice(0, len(own.ids)))
    true = own.z @ own.z.T
    assert (low <= true).all() and (true <= high).all()
    # Of what lies below the fifth best score of a row, the bound alone tells most apart.
    fifth = np.sort(true, axis=1)[:, -6]
    assert (high < fifth[:, None]).sum() > 0.5 * (true < fifth[:, None]).sum()
