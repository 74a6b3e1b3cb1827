"""Nearest neighbours: recall, exact scores, ties, copies, and vectors that take no part."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tablegauge.llm import neighbours as N
from tablegauge.llm.common import table

SCHEMA = "vec_id bigint, embedding array<float>, pivot int, part string, vector string"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 0, "x", "y") for i, v in rows], SCHEMA).repartition(3)


def exact(rows, k):
    """The nearest of each query by id, by brute force."""
    known = {i: np.array(v, dtype=np.float32).astype(np.float64) for i, v in rows}
    out = {}
    for q in (i for i in known if i % 20 == 0):
        scored = sorted(((-float((known[q] * v).sum()), i) for i, v in known.items() if i != q))
        out[q] = [(i, -s) for s, i in scored[:k]]
    return out


def by_query(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r.rank == len(out[r.query_id])
    return out


@pytest.mark.parametrize("parts", [(4_096, 1_024), (50, 10)])
def test_recall_on_the_given_vectors(spark, sf_dir, monkeypatch, parts):
    monkeypatch.setattr(N, "PART_VECTORS", parts[0])
    monkeypatch.setattr(N, "PART_QUERIES", parts[1])
    rows = table(spark, sf_dir.replace("0.001", "0.01"), "embeddings")
    truth = exact([(r.vec_id, r.embedding) for r in rows.collect()], 20)
    got = by_query(N.nearest(rows, F.col("vec_id") % 20 == 0))
    assert set(got) == set(truth) and all(len(x) == 20 for x in got.values())
    hits = sum(len({i for i, _ in got[q]} & {i for i, _ in truth[q]}) for q in truth)
    assert hits >= 0.9 * 20 * len(truth)
    scores = {(q, i): s for q in truth for i, s in truth[q]}
    assert all(abs(s - scores[q, i]) < 1e-12 for q in got for i, s in got[q] if (q, i) in scores)


def test_copies_and_ties_go_to_the_smaller_id(spark):
    own = np.random.default_rng(5)
    same = own.normal(size=8).tolist()
    rows = [(i, same) for i in range(300)] + [(300 + i, own.normal(size=8).tolist()) for i in range(300)]
    got, truth = by_query(N.nearest(frame(spark, rows), F.col("vec_id") % 20 == 0)), exact(rows, 20)
    for q in (0, 40, 280):  # a few longer vectors come first, then the copies by id
        assert [i for i, _ in got[q]] == [i for i, _ in truth[q]] and sum(i < 300 for i, _ in got[q]) > 10


def test_lengths_count(spark):
    """Vectors of very different lengths: the longest are near to many."""
    own = np.random.default_rng(6)
    rows = [(i, (own.normal(size=16) * own.lognormal(0, 1)).tolist()) for i in range(3000)]
    got, truth = by_query(N.nearest(frame(spark, rows), F.col("vec_id") % 20 == 0)), exact(rows, 20)
    assert sum(len({i for i, _ in got[q]} & {i for i, _ in truth[q]}) for q in truth) >= 0.9 * 20 * len(truth)


def test_few_and_odd_vectors(spark):
    good = [(i, [1.0 + i, 2.0, -1.0]) for i in range(0, 12)]
    odd = [(20, None), (40, [0.0, 0.0, 0.0]), (60, [1.0, None, 2.0]), (80, [float("nan"), 1.0, 1.0]), (100, [float("inf"), 1.0, 1.0]), (None, [1.0, 1.0, 1.0]),
           (120, [1.0, 2.0]), (0, [1.0, 2.0, -1.0])]
    got = by_query(N.nearest(frame(spark, good + odd), F.col("vec_id") % 20 == 0))
    assert set(got) == {0} and [i for i, _ in got[0]] == list(range(11, 0, -1))
    assert N.nearest(frame(spark, []), F.col("vec_id") % 20 == 0).collect() == []
    assert N.nearest(frame(spark, [(0, [1.0, 2.0])]), F.col("vec_id") % 20 == 0).collect() == []
    assert by_query(N.nearest(frame(spark, [(0, [1.0, 2.0]), (1, [1.0, 2.0])]), F.col("vec_id") % 20 == 0)) == {0: [(1, 5.0)]}


def test_one_very_long_vector_leaves_the_others_their_neighbours(spark):
    own = np.random.default_rng(9)
    x = own.normal(size=(1_000, 16))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(1_001, (x[0] * 1e6).tolist())]
    truth, got = exact(rows, 10), by_query(N.nearest(frame(spark, rows), F.col("vec_id") % 20 == 0, k=10))
    hits = sum(len({i for i, _ in got[q]} & {i for i, _ in truth[q]}) for q in truth)
    assert hits >= 0.95 * 10 * len(truth)
