"""Meta-features, split, baseline and risk model on small fixtures."""

import json
import random
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tablegauge.operators import correlation as R
from tablegauge.operators import learn as N
from tablegauge.operators.learn import MacroF1, encode_labels, meta_train_shared
from tablegauge.operators import meta as M
from tablegauge.operators.meta import META_FEATURES
from tablegauge.sources.sinks import sink_meta_csv
from tablegauge.sources.readers import scan_csv


@pytest.fixture(scope="module")
def flowers(spark):
    """150 rows, four features, three classes that the features tell apart."""
    rng = random.Random(1)
    rows = [(5 + c + rng.gauss(0, 0.2), 3 + rng.gauss(0, 0.3), 1.5 + 2 * c + rng.gauss(0, 0.2), c + rng.gauss(0, 0.1), c)
            for c in range(3) for _ in range(50)]
    return spark.createDataFrame(rows, "a double, b double, c double, d double, target int")


def test_meta_features_of_a_hand_made_table(spark):
    df = spark.createDataFrame(
        [(1.0, 1.0, 5.0, "x")] * 2 + [(2.0, 4.0, 5.0, "x"), (3.0, None, 5.0, "x"), (4.0, 16.0, 5.0, "y")],
        "a double, b double, k double, target string")
    got = M.meta_features(df, "target").first()
    assert (got["n_samples"], got["n_features"], got["ratio"]) == (5, 3, 0.6)
    assert got["imbalance"] == 0.8 and got["missing"] == round(1 / 15, 4) and got["duplicate_pct"] == 0.2
    import statistics
    assert got["variance"] == round(statistics.mean([statistics.variance([1, 1, 2, 3, 4]), statistics.variance([1, 1, 4, 16]), 0]), 4)
    assert 0 < got["correlation"] <= 1 and got["skewness"] > 0


def test_meta_features_by_key_equal_those_of_each_part(spark):
    df = spark.range(600).select(
        (F.col("id") % 3).alias("g"), ((F.col("id") * 7919) % 101).cast("double").alias("a"),
        F.when(F.col("id") % 5 > 0, (F.col("id") * F.col("id")) % 37).alias("b"), F.lit(1.0).alias("c"),
        F.when(F.col("id") % 4 == 0, "x").otherwise("y").alias("target"))
    by = {r["g"]: r for r in M.meta_features_by(df, ["g"], "target").collect()}
    for g in range(3):
        one = M.meta_features(df.filter(F.col("g") == g).drop("g"), "target").first().asDict()
        assert {k: by[g][k] for k in one} == pytest.approx(one)


@pytest.mark.parametrize("kept", [1, 1 << 20])
def test_mean_correlation_by_key_in_parts(spark, monkeypatch, kept):
    monkeypatch.setattr(R, "_MERGE_BYTES", kept)  # matrices are handed on after each key, and merged two at a time
    names = ["a", "b", "c"]
    df = spark.range(0, 3000, 1, 7).select(
        F.when(F.col("id") % 3 > 0, "hot").when(F.col("id") % 2 == 0, "it's").alias("g"), (F.col("id") % 2).alias("h"),
        ((F.col("id") * 7919) % 101).alias("a"), F.when(F.col("id") % 5 > 0, (F.col("id") * F.col("id")) % 37).alias("b"),
        F.when(F.col("id") % 2 == 0, 1.0).otherwise(F.col("id") % 11).alias("c"))
    got = {(r["g"], r["h"]): r["correlation"] for r in R.mean_abs_correlation_by(df, ["g", "h"], names, 2).collect()}
    assert set(got) == {("hot", 0), ("hot", 1), ("it's", 0), (None, 1)}
    for (g, h), r in got.items():
        part = df.filter(F.col("g").eqNullSafe(F.lit(g)) & (F.col("h") == h))
        known = [abs(x) for x in R.correlations(part, list(combinations(names, 2))).values() if x is not None]
        assert r == pytest.approx(sum(known) / len(known))
    flat = df.filter("h = 0").select("g", "c", F.col("c").alias("d"))
    assert {r["correlation"] for r in R.mean_abs_correlation_by(flat, ["g"], ["c", "d"]).collect()} == {None}
    assert R.mean_abs_correlation_by(df.limit(0), ["g"], names).collect() == []


def test_matrices_of_many_small_groups_are_made_together(monkeypatch):
    """As each group by itself, merged or not; and the number of groups does not make the calls."""
    own = np.random.default_rng(3)
    x = own.normal(5, 2, (3000, 4))
    x[own.random(x.shape) < 0.2] = np.nan
    x[:40, 1], x[300:310] = 7.0, np.nan
    starts = np.concatenate([[0], np.sort(own.choice(np.arange(1, 1500), 400, replace=False)), [1500]])
    ends = np.append(starts[1:], len(x))
    alone = np.stack([R._block(x[a:b]) for a, b in zip(starts, ends)], axis=1)
    calls = []
    monkeypatch.setattr(R, "_block", lambda rows, one=R._block: calls.append(len(rows)) or one(rows))
    monkeypatch.setattr(R, "_BLOCK_BYTES", 8 * 16 * 200)
    got = R._grouped(x, starts)
    assert calls == [1500] and got.shape == alone.shape
    there = alone[R._N] > 0
    for i in range(6):
        assert np.allclose(got[i][there], alone[i][there], rtol=1e-9, atol=1e-9)
    pairs = R._merged(alone[:, :200], alone[:, 200:400])
    for g in range(200):
        assert np.allclose(pairs[:, g], R._merged(alone[:, g], alone[:, 200 + g]), equal_nan=True)


def test_unknown_target_is_refused(spark):
    with pytest.raises(ValueError, match="not found"):
        M.meta_features(spark.range(3).toDF("a"), "target")


def test_split_keeps_shares_per_class(spark):
    df = spark.range(1000).select("id", F.when(F.col("id") % 10 == 0, "rare").otherwise("usual").alias("y"))
    for key in (["id"], None):
        marked = N.split_train_test(df, "y", 0.3, key=key)
        got = {(r["y"], r["is_test"]): r["count"] for r in marked.groupBy("y", "is_test").count().collect()}
        assert got == {("rare", True): 30, ("rare", False): 70, ("usual", True): 270, ("usual", False): 630}


def test_split_of_a_target_with_many_values(spark):
    marked = N.split_train_test(spark.range(101).toDF("y"), "y", 0.2, key=["y"])
    assert marked.filter("is_test").count() == 21


def test_encode_labels_in_sorted_order_with_a_class_for_gaps(spark):
    df = spark.createDataFrame([("b", 1), ("a", 2), (None, 3), ("z", 4)], "t string, i int")
    assert {r["i"]: r["t"] for r in N.encode_labels(df, ["t"]).collect()} == {2: 0, 1: 1, 3: 2, 4: 3}


def test_baseline_learns_separable_classes(flowers):
    got = N.baseline_eval(flowers, "target").first()
    assert got["train_acc"] > 0.95 and got["test_acc"] > 0.9
    assert got["gap"] == pytest.approx(got["train_acc"] - got["test_acc"], abs=1e-4)


def test_baseline_takes_text_gaps_and_flags(spark):
    df = spark.range(200).select(
        F.when(F.col("id") % 7 > 0, F.concat(F.lit("c"), (F.col("id") % 2).cast("string"))).alias("t"),
        F.when(F.col("id") % 5 > 0, F.col("id") * 1.0).alias("x"), (F.col("id") % 2 == 0).alias("f"),
        F.lit(None).cast("double").alias("void"),
        F.when(F.col("id") % 2 == 0, "even").when(F.col("id") % 11 > 0, "odd").alias("target"))
    assert N.baseline_eval(df, "target").first()["test_acc"] > 0.95


def test_baseline_refuses_small_tables(spark):
    with pytest.raises(ValueError, match="too small"):
        N.baseline_eval(spark.range(19).select("id", F.lit("a").alias("target")), "target")


def test_meta_dataset_skips_what_fails(spark, flowers):
    tables = {"flowers": flowers, "tiny": flowers.limit(5), "none": spark.range(40).toDF("x"),
              "gone": lambda: spark.read.parquet("/nowhere")}
    found, skipped = N.meta_dataset(spark, tables)
    assert [(r["table_name"], r["risk"]) for r in found.collect()] == [("flowers", "Safe Dataset")]
    assert {r["table_name"] for r in skipped.collect()} == {"tiny", "none", "gone"}
    with pytest.raises(RuntimeError):
        N.meta_dataset(spark, {"none": spark.range(40).toDF("x")})


@pytest.fixture(scope="module")
def meta(spark):
    """150 rows, 50 per label, with labels that follow from a few of the numbers."""
    rng = random.Random(5)
    rows = []
    for label in ("Overfitting Risk", "Safe Dataset", "Underfitting Risk"):
        for _ in range(50):
            n = rng.randint(60, 900) if label == "Overfitting Risk" else rng.randint(1500, 40000)
            rows.append((
                n, rng.randint(2, 200), rng.random(), rng.random() * 1e4, rng.random(),
                rng.uniform(0.86, 0.98) if label == "Overfitting Risk" else rng.uniform(0.34, 0.8),
                rng.uniform(0.32, 0.49) if label == "Underfitting Risk" else rng.uniform(0, 0.25),
                rng.random() * 4, rng.random() * 0.2, rng.random() * 0.3, label))
    names = [*M.META_FEATURES, "risk"]
    kinds = ["long", "long"] + ["double"] * 8 + ["string"]
    return spark.createDataFrame(rows, ", ".join(f"{n} {k}" for n, k in zip(names, kinds))).repartition(2)


def test_risk_model_from_training_to_prediction(spark, meta, flowers, tmp_path):
    grid = {"numTrees": [20], "maxDepth": [8], "minInstancesPerNode": [1], "weightCol": ["weight_balanced", "weight_equal"]}
    model = N.meta_train(meta, grid, folds=3)
    assert model.test.count() == 30 and model.train.count() == 120 and model.cv_f1 > 0.9
    report = {r["risk"]: r for r in N.meta_evaluate(model).collect()}
    assert sum(r["support"] for r in report.values()) == 30 and all(r["f1"] > 0.8 for r in report.values())
    matrix = N.confusion_matrix(model).collect()
    assert sum(sum(v for k, v in r.asDict().items() if k != "risk") for r in matrix) == 30
    gap = N.train_test_gap(model).first()
    assert gap["train_acc"] > 0.9 and not gap["possible_overfit"]
    weights = N.feature_importance(spark, model.pipeline).collect()
    assert len(weights) == 10 and weights[0]["importance"] >= weights[-1]["importance"]
    path = str(tmp_path / "model")
    N.save_model(model.pipeline, path)
    again = N.predict_risk(N.load_model(spark, path), flowers, "target").first()
    assert again["predicted_risk"] == N.predict_risk(model.pipeline, flowers, "target").first()["predicted_risk"]
    with pytest.raises(FileNotFoundError):
        N.load_model(spark, str(tmp_path / "other"))


def test_macro_f1_weighs_classes_equally(spark):
    df = spark.createDataFrame([(0.0, 0.0)] * 8 + [(1.0, 0.0), (1.0, 1.0)], "label double, prediction double")
    f0, f1 = 2 * (8 / 9) / (8 / 9 + 1), 2 * (1 * 0.5) / 1.5
    assert N.MacroF1().evaluate(df) == pytest.approx((f0 + f1) / 2)


def test_meta_dataset_round_trip_and_guard(spark, meta, tmp_path):
    path = str(tmp_path / "meta")
    sink_meta_csv(meta, path)
    again = scan_csv(spark, path)
    assert again.count() == 150 and again.columns == meta.columns
    with pytest.raises(ValueError, match="outlier_pct"):
        N.meta_schema_guard(again.drop("outlier_pct"))


def test_codes_of_all_columns_come_from_one_dictionary(spark):
    df = spark.createDataFrame([("b", "x", 1), ("a", None, 2), ("b", "y", 3), (None, "x", 4), ("nan", "é", 5)], "t string, u string, __n int")
    got = [tuple(r) for r in encode_labels(df, ["t", "u"]).orderBy("__n").collect()]
    assert got == [(1, 1, 1), (0, 0, 2), (1, 2, 3), (2, 1, 4), (2, 3, 5)]
    assert encode_labels(df, []).columns == df.columns and encode_labels(df.limit(0), ["t", "u"]).count() == 0


def test_training_is_shared_by_rows_and_settings(spark):
    own = random.Random(4)
    rows = [(own.choice(["Overfitting Risk", "Safe Dataset", "Underfitting Risk"]), *[own.random() for _ in META_FEATURES]) for _ in range(60)]
    columns = "risk string, " + ", ".join(f"{f} double" for f in META_FEATURES)
    grid = {"numTrees": [3], "maxDepth": [2, 3], "minInstancesPerNode": [1], "weightCol": ["weight_equal"]}
    first = meta_train_shared(spark.createDataFrame(rows, columns), grid, folds=2)
    group = "shared"
    spark.sparkContext.setJobGroup(group, group)
    again = meta_train_shared(spark.createDataFrame(rows[::-1], columns).repartition(3), grid, folds=2)  # rows in any order
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert again.scores == first.scores and len(first.scores) == 2 and all(r["deviation"] >= 0 for r in first.scores)
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup(group)) < 20  # it was read, not trained
    assert again.pipeline.stages[-1].featureImportances == first.pipeline.stages[-1].featureImportances
    other = meta_train_shared(spark.createDataFrame(rows[1:], columns), grid, folds=2)
    assert other.train.count() + other.test.count() == 59


def test_macro_f1_is_the_mean_over_the_classes_that_occur(spark):
    rows = spark.createDataFrame([(0.0, 0.0), (0.0, 1.0), (1.0, 1.0), (1.0, 1.0), (2.0, 0.0)], "label double, prediction double")
    assert MacroF1().evaluate(rows) == pytest.approx((0.5 + 0.8 + 0.0) / 3)
    assert MacroF1().evaluate(rows.limit(0)) == 0.0


def test_features_and_baseline_of_many_datasets_are_made_together(spark, monkeypatch):
    import threading

    met = threading.Barrier(2, timeout=20)

    def waiting(fn):
        def run(*args, **kwargs):
            met.wait()
            return fn(*args, **kwargs)
        return run

    for name in ("meta_features_by", "scored_baseline"):
        monkeypatch.setattr(N, name, waiting(getattr(N, name)))
    df = spark.range(120).selectExpr("id % 2 as g", "cast(id as double) as x", "cast(id % 7 as double) as y", "if(id % 4 < 2, 'a', 'b') as target")
    got = N.meta_dataset_by(df, ["g"], "target").collect()
    assert sorted((r["g"], r["n_samples"]) for r in got) == [(0, 60), (1, 60)]
    assert all(r["risk"] for r in got)


def test_folds_searched_together_give_the_scores_of_the_cross_validator(spark, monkeypatch):
    from pyspark.ml.tuning import CrossValidator

    monkeypatch.setattr(CrossValidator, "_fit", lambda *_: pytest.fail("a fold after the other"))
    rng = random.Random(8)
    rows = [(*[rng.gauss(i % 3, 2) for _ in N.META_FEATURES], N.RISK_LABELS[i % 3]) for i in range(150)]
    meta = spark.createDataFrame(rows, [*N.META_FEATURES, "risk"])
    model = N.meta_train(meta, {"numTrees": [5], "maxDepth": [3, 1]}, folds=3)
    monkeypatch.undo()
    forest = model.pipeline.stages[-1]
    estimator = N.RandomForestClassifier(featuresCol="features", labelCol="label", seed=N.SEED)
    pipeline = N.Pipeline(stages=[model.pipeline.stages[0], estimator])
    grid = N.ParamGridBuilder().addGrid(estimator.numTrees, [5]).addGrid(estimator.maxDepth, [3, 1]).build()
    fitted = CrossValidator(estimator=pipeline, estimatorParamMaps=grid, evaluator=N.MacroF1(), numFolds=3, seed=N.SEED).fit(model.train)
    assert [r["mean"] for r in model.scores] == pytest.approx(fitted.avgMetrics)
    assert [r["deviation"] for r in model.scores] == pytest.approx(fitted.stdMetrics)
    assert forest.toDebugString.splitlines()[1:] == fitted.bestModel.stages[-1].toDebugString.splitlines()[1:]


def _few_settings(spark, monkeypatch):
    """The queries over 60 rows of their own and a search of two settings; the trainings and readings of models are listed."""
    from suite import learning as Q

    own = random.Random(6)
    rows = [(i, own.choice(["Overfitting Risk", "Safe Dataset", "Underfitting Risk"]), *[own.random() for _ in META_FEATURES]) for i in range(60)]
    meta = spark.createDataFrame(rows, "slice long, risk string, " + ", ".join(f"{f} double" for f in META_FEATURES))
    calls = []
    monkeypatch.setattr(Q, "_slices", lambda *_: meta)
    monkeypatch.setattr(Q, "_rows_of", {})
    monkeypatch.setattr(N, "GRID", {"numTrees": [3, 4], "maxDepth": [2], "minInstancesPerNode": [1], "weightCol": ["weight_equal"]})
    for name in ("meta_train", "load_model"):
        monkeypatch.setattr(N, name, lambda *args, name=name, real=getattr(N, name): calls.append(name) or real(*args))
    return Q, calls


def test_registered_model_searches_all_settings_of_the_library(spark, monkeypatch):
    from suite import learning as Q

    assert "36::bigint as settings" in Q.ORACLES["meta_train"]
    Q, calls = _few_settings(spark, monkeypatch)
    found = [json.loads(r["settings"])["numTrees"] for r in Q.meta_train_values(spark, "few").collect()]
    assert sorted(found) == [3, 4] and calls == ["meta_train"]
    assert Q.feature_importance_values(spark, "few").count() == 10 and calls == ["meta_train"]


def test_saved_model_was_fitted_and_not_read(spark, monkeypatch):
    Q, calls = _few_settings(spark, monkeypatch)
    for _ in range(2):
        calls.clear()
        rows = Q.model_save_load_values(spark, "few").collect()
        assert calls == ["meta_train", "load_model"]
        assert len(rows) == 12 and all(r["same"] and r["fitted"] == r["reloaded"] for r in rows)
