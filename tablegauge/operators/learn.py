"""Baseline model, risk label and the meta-model that learns it, on ``pyspark.ml``."""

from __future__ import annotations

import json
import math
from concurrent.futures import ThreadPoolExecutor

import numpy as np
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.evaluation import Evaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector
from pyspark.ml.tuning import ParamGridBuilder
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tablegauge.functions import keywords as K
from tablegauge.functions.classes import columns_of, text_form
from tablegauge.functions.joins import joined_by_key
from tablegauge.functions.nulls import normalize_nulls, quoted
from tablegauge.functions.rules import RISK_LABELS, risk_label
from tablegauge.functions.session import checkpointed, local_rows, together, written
from tablegauge.operators.logistic import MOST_COEFFICIENTS, newton, predicted
from tablegauge.operators.meta import META_FEATURES, meta_features, meta_features_by, scan_list
from tablegauge.operators.quantiles import order_statistics
from tablegauge.operators.ranks import ordered_codes, positions
from tablegauge.operators.remediate import fix_fill_median, fix_standardize

SEED = 42
MIN_ROWS = 20


def encode_labels(df: DataFrame, cols: list[str]) -> DataFrame:
    """Text columns become codes in sorted order; a missing value is a class called ``nan``.

    The codes of all columns are one dictionary of (column, value), numbered per column by one sort over all of it and fixed by
    one checkpoint. It is a joined table, not a list on the driver, so a column may have any number of classes.
    """
    if not cols:
        return df
    named = {c: F.coalesce(quoted(c).cast("string"), F.lit("nan")) for c in cols}
    cells = df.select([x.alias(str(i)) for i, x in enumerate(named.values())]).unpivot([], [str(i) for i in range(len(cols))], "column", "value")
    ranked = positions(cells.distinct().withColumn("one", F.lit(1).cast("long")), ["column"], "value", "one")
    codes = checkpointed(ranked.select("column", F.col("value").alias("__value"), F.col("first").alias("__code")))
    out = df
    for i, (c, x) in enumerate(named.items()):
        own = codes.where(F.col("column") == str(i)).drop("column")
        out = joined_by_key(out.withColumn("__value", x), own, ["__value"], "left").withColumn(c, F.col("__code")).drop("__value", "__code")
    return out.select(df.columns)


def _order_value(keys: list[str], seed: int) -> Column:
    """A number in [0, 2^52) that depends on the row's key only."""
    digest = F.md5(F.concat_ws("|", *[quoted(k).cast("string") for k in keys], F.lit(str(seed))).cast("binary"))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double")


def _test_sizes(counts: dict, share: float) -> dict:
    """Rows to hold out per class: whole parts first, then the largest remainders."""
    n = sum(counts.values())
    total = math.ceil(share * n)
    exact = {c: total * k / n for c, k in counts.items()}
    sizes = {c: math.floor(v) for c, v in exact.items()}
    rest = total - sum(sizes.values())
    for c in sorted(counts, key=lambda c: (sizes[c] - exact[c], str(c)))[:rest]:
        sizes[c] += 1
    return sizes


def split_train_test(
    df: DataFrame, target: str, share: float = 0.3, seed: int = SEED, key: list[str] | None = None
) -> DataFrame:
    """Adds ``is_test``: the share of rows, kept per class while there are at most 20 classes.

    Rows are ordered by a number drawn per row; the rank that ends the test part is found by
    selection, so no class is sorted in one task. With ``key`` the number follows from the key;
    without, it is random and fixed by a written table.
    """
    if key:
        rows = df.withColumn("__u", _order_value(key, seed))
    else:
        rows = written(df.withColumn("__u", F.rand(seed)), "split")
    counts = {r["c"]: r["n"] for r in rows.groupBy(quoted(target).alias("c")).agg(F.count("*").alias("n"))
              .orderBy("c").limit(K.FEW_DISTINCT + 1).collect()}
    if len(counts) > K.FEW_DISTINCT:
        counts = {None: rows.count()}
        parts = {None: F.col("__u")}
    else:
        parts = {c: F.when(quoted(target).eqNullSafe(F.lit(c)), F.col("__u")) for c in counts}
    sizes = _test_sizes(counts, share)
    labels = {f"c{i}": c for i, c in enumerate(counts)}
    found = order_statistics(
        rows, {k: parts[c] for k, c in labels.items()},
        {k: [sizes[c] - 1] for k, c in labels.items()}, {k: counts[c] for k, c in labels.items()},
    )
    is_test = F.lit(False)
    for k, c in labels.items():
        if sizes[c]:
            is_test = is_test | F.coalesce(parts[c] <= F.lit(found[k, sizes[c] - 1]), F.lit(False))
    return rows.withColumn("is_test", is_test).drop("__u")


def prepare_features(
    df: DataFrame, target: str, carry: list[str] = ()
) -> tuple[DataFrame, list[str]]:
    """``label``, the usable features as numbers, and the carried columns as they are.

    Text becomes codes, gaps become medians, flags become 0 and 1; dates are left out.
    """
    features = [c for c in df.columns if c != target and c not in carry]
    rows = normalize_nulls(df.dropna(subset=[target]))
    flat = text_form(rows.select([quoted(c) for c in features]))
    text, numeric, flags = (columns_of(flat, k) for k in ("categorical", "numeric", "boolean"))
    shown = {f.name: c for f, c in zip(flat.schema, _cells(rows, features))}
    rows = rows.select(
        quoted(target).cast("string").alias("__target"), *[quoted(c).alias(f"__carry_{c}") for c in carry],
        *[shown[c].cast("double").alias(c) if c in flags else shown[c].alias(c) for c in features],
    )
    rows = encode_labels(rows, text)
    rows = fix_fill_median(rows, numeric) if numeric else rows
    names = [c for c in features if c in {*text, *numeric, *flags}]
    label = ordered_codes(rows, "__target").select(
        F.col("value").alias("__target"), F.col("code").cast("double").alias("label"))
    rows = joined_by_key(rows, label, ["__target"])
    cells = [F.coalesce(quoted(c).cast("double"), F.lit(0.0)).alias(c) for c in names]
    return rows.select("label", *[quoted(f"__carry_{c}").alias(c) for c in carry], *cells), names


def _cells(rows: DataFrame, features: list[str]) -> list[Column]:
    """Nested and binary features as text, the others unchanged."""
    out = []
    for c in features:
        kind = rows.schema[c].dataType.typeName()
        x = quoted(c)
        if kind in ("array", "map", "struct"):
            x = F.when(x.isNotNull(), F.to_json(x))
        elif kind == "binary":
            x = F.base64(x)
        out.append(x)
    return out


def _vector(df: DataFrame, names: list[str]) -> DataFrame:
    return df.withColumn("features", array_to_vector(F.array(*[quoted(c) for c in names])))


def scored_baseline(
    df: DataFrame, target: str, share: float = 0.3, seed: int = SEED, carry: list[str] = ()
) -> DataFrame:
    """Every row with ``is_test``, ``label`` and the ``prediction`` of a scaled logistic regression."""
    n = df.filter(quoted(target).isNotNull()).count()
    if n < MIN_ROWS:
        raise ValueError(f"dataset too small for an evaluation: {n} rows, {MIN_ROWS} needed")
    features, names = prepare_features(df, target, carry)
    marked = split_train_test(features, "label", share, seed)
    train = marked.filter(~F.col("is_test"))
    ready = fix_standardize(train, names, also=[marked])[1]
    counts = {r["label"]: r["n"] for r in train.groupBy("label").agg(F.count("*").alias("n")).orderBy(F.desc("label")).limit(MOST_COEFFICIENTS + 1).collect()}
    # The inverse regularisation strength of one that the baseline asks for, per training row.
    strength = 1.0 / train.count()
    learned = ready.filter(~F.col("is_test"))
    coefficients = newton(learned, names, "label", [counts.get(float(k), 0) for k in range(int(max(counts, default=-1)) + 1)], strength)
    if coefficients is not None:
        return predicted(ready, names, coefficients)
    # Very many coefficients, or odd cells.
    model = LogisticRegression(maxIter=1000, regParam=strength, standardization=False).fit(_vector(learned, names))
    return model.transform(_vector(ready, names))


def accuracies(scored: DataFrame, *keys: str) -> DataFrame:
    hit = F.when(F.col("prediction") == F.col("label"), 1.0).otherwise(0.0)
    train = F.avg(F.when(~F.col("is_test"), hit))
    test = F.avg(F.when(F.col("is_test"), hit))
    return scored.groupBy(*keys).agg(
        F.round(train, 4).alias("train_acc"), F.round(test, 4).alias("test_acc"),
        F.round(train - test, 4).alias("gap"))


def baseline_eval(df: DataFrame, target: str, share: float = 0.3, seed: int = SEED) -> DataFrame:
    """One row: accuracy on training and test rows, and the gap between them."""
    _need(df, target)
    return accuracies(scored_baseline(df, target, share, seed))


def _need(df: DataFrame, target: str) -> None:
    if target not in df.columns:
        raise ValueError(f"target column {target!r} not found; columns are {df.columns}")


def assign_risk(features: DataFrame) -> DataFrame:
    """Adds ``risk`` from accuracies and meta-features."""
    c = F.col
    label = risk_label(c("train_acc"), c("test_acc"), c("gap"), c("n_samples"), c("imbalance"), c("missing"))
    return features.withColumn("risk", label)


def meta_row(df: DataFrame, target: str) -> DataFrame:
    """One row: meta-features and risk label of one dataset."""
    accuracy = baseline_eval(df, target)
    row = meta_features(df, target).crossJoin(F.broadcast(accuracy))  # one row each
    return assign_risk(row).select(*META_FEATURES, "risk")


def meta_dataset(spark: SparkSession, tables: dict, target: str = "target") -> tuple[DataFrame, DataFrame]:
    """Features and label of every table that has the target, and the tables that were skipped."""
    def measure(name: str, df: DataFrame) -> DataFrame:
        rows = [tuple(r) for r in meta_row(df, target).collect()]
        return local_rows(spark, [(name, *r) for r in rows], META_ROW)

    return scan_list(spark, tables, target, measure)


META_ROW = ("table_name string, n_samples long, n_features long, "
            + ", ".join(f"{f} double" for f in META_FEATURES[2:]) + ", risk string")


def meta_dataset_by(df: DataFrame, keys: list[str], target: str) -> DataFrame:
    """Features and label of many datasets kept in one table, one row per combination of the keys.

    One baseline is fitted over all of them and judged per dataset.
    """
    # Neither needs the other; the many short jobs of the baseline leave cores to the features.
    features, accuracy = together([
        lambda: checkpointed(meta_features_by(df, keys, target)),
        lambda: checkpointed(accuracies(scored_baseline(df, target, carry=keys), *keys)),
    ])
    return assign_risk(features.join(accuracy, keys, "left")).select(*keys, *META_FEATURES, "risk")


def meta_schema_guard(meta: DataFrame) -> DataFrame:
    """The table itself if all feature columns are there, else an error naming the missing ones."""
    lost = [c for c in META_FEATURES if c not in meta.columns]
    if lost:
        raise ValueError(f"meta dataset lacks the columns {lost}; build it again")
    return meta


class MacroF1(Evaluator):
    """Mean F1 over the classes that occur; the built-in ``f1`` weighs classes by size."""

    def _evaluate(self, dataset: DataFrame) -> float:
        cells = dataset.groupBy("label", "prediction").count().collect()  # classes times classes
        real, told, hits = {}, {}, {}
        for r in cells:
            real[r["label"]] = real.get(r["label"], 0) + r["count"]
            told[r["prediction"]] = told.get(r["prediction"], 0) + r["count"]
            if r["label"] == r["prediction"]:
                hits[r["label"]] = r["count"]
        classes = {*real, *told}
        return sum(2 * hits.get(c, 0) / (real.get(c, 0) + told.get(c, 0)) for c in classes) / len(classes) if classes else 0.0

    def isLargerBetter(self) -> bool:
        return True


def class_report(predictions: DataFrame) -> DataFrame:
    """``label, precision, recall, f1, support`` per class, from the confusion counts."""
    c = F.col
    cells = predictions.groupBy("label", "prediction").agg(F.count("*").alias("n"))
    ends = cells.select(F.explode(F.array(
        F.struct(c("label").alias("label"), c("n").alias("support"), F.lit(0).cast("long").alias("predicted"),
                 F.when(c("label") == c("prediction"), c("n")).otherwise(0).alias("hits")),
        F.struct(c("prediction").alias("label"), F.lit(0).cast("long").alias("support"),
                 c("n").alias("predicted"), F.lit(0).cast("long").alias("hits")),
    )).alias("e")).select("e.*")
    sums = ends.groupBy("label").agg(*[F.sum(k).alias(k) for k in ("support", "predicted", "hits")])
    zero = F.lit(0.0)
    precision = F.coalesce(F.try_divide("hits", "predicted"), zero)
    recall = F.coalesce(F.try_divide("hits", "support"), zero)
    return sums.select("label", "support", precision.alias("precision"), recall.alias("recall")).withColumn(
        "f1", F.coalesce(F.try_divide(2 * c("precision") * c("recall"), c("precision") + c("recall")), zero))


def _labelled(meta: DataFrame) -> DataFrame:
    """The risk as class index with its names, so that an absent class is still known."""
    index = F.lit(None).cast("double")
    for i, name in enumerate(RISK_LABELS):
        index = F.when(F.col("risk") == name, float(i)).otherwise(index)
    about = {"ml_attr": {"type": "nominal", "name": "label", "vals": list(RISK_LABELS)}}
    return meta.withColumn("label", index).withColumn("label", F.col("label").alias("label", metadata=about))


def _weighted(rows: DataFrame) -> DataFrame:
    """Both weightings the grid may choose from: equal, and balanced over the classes."""
    counts = rows.groupBy("label").agg(F.count("*").alias("__n"))
    total = counts.agg(F.sum("__n").alias("__all"), F.count("*").alias("__k"))
    weights = counts.crossJoin(F.broadcast(total))  # as many rows as risk labels: three
    joined = rows.join(F.broadcast(weights), "label")
    return joined.select(*rows.columns, F.lit(1.0).alias("weight_equal"),
                         (F.col("__all") / (F.col("__k") * F.col("__n"))).alias("weight_balanced"))


# The settings searched. Depth 30 is the deepest Spark grows; node sizes stand for split sizes.
GRID = {"numTrees": [100, 200, 300], "maxDepth": [30, 8, 16], "minInstancesPerNode": [1, 2],
        "weightCol": ["weight_balanced", "weight_equal"]}


# Meta rows in a partition of the training.
ROWS_PER_PART = 50_000


class MetaModel:
    """A fitted forest over the meta-features, with the rows it was trained and tested on.

    ``scores`` has the settings tried, each with the mean and the deviation of its F1 over the folds.
    """

    def __init__(self, pipeline: PipelineModel, train: DataFrame, test: DataFrame, scores: list[dict]):
        self.pipeline, self.train, self.test, self.scores = pipeline, train, test, scores
        best = max(scores, key=lambda r: r["mean"])  # the first of equal ones
        self.cv_f1, self.cv_std, self.settings = best["mean"], best["deviation"], best["settings"]


def meta_train(meta: DataFrame, grid: dict | None = None, folds: int = 5, seed: int = SEED,
               parallelism: int = 4) -> MetaModel:
    """Random forest chosen by cross-validated macro F1 on 80 % of the rows, stratified; ``parallelism`` fits per fold at a time."""
    rows = _labelled(meta_schema_guard(meta)).dropna(subset=["label"])
    about = rows.schema["label"].metadata
    marked = checkpointed(split_train_test(rows, "label", 0.2, seed))
    marked = marked.withColumn("label", F.col("label").alias("label", metadata=about))
    train = _weighted(marked.filter(~F.col("is_test")))
    # As many partitions as the rows need: each level of each tree is a job over them.
    parts = max(1, train.count() // ROWS_PER_PART)
    train = checkpointed(train.repartition(parts, *META_FEATURES)).withColumn("label", F.col("label").alias("label", metadata=about))
    test = marked.filter("is_test")
    forest = RandomForestClassifier(featuresCol="features", labelCol="label", seed=seed)
    pipeline = Pipeline(stages=[
        VectorAssembler(inputCols=list(META_FEATURES), outputCol="features"), forest])
    builder = ParamGridBuilder()
    for name, values in (grid or GRID).items():
        builder = builder.addGrid(forest.getParam(name), values)
    grid = builder.build()
    found = _fold_scores(pipeline, grid, train, folds, seed, parallelism)
    means, deviations = np.mean(found, axis=0), np.std(found, axis=0)
    scores = [{"settings": {p.name: v for p, v in m.items()}, "mean": float(mean), "deviation": float(std)}
              for m, mean, std in zip(grid, means, deviations)]
    return MetaModel(pipeline.fit(train, grid[int(np.argmax(means))]), train, test, scores)


def _fold_scores(pipeline: Pipeline, grid: list[dict], train: DataFrame, folds: int, seed: int, parallelism: int) -> list[list[float]]:
    """Macro F1 per fold and setting, over the folds that ``CrossValidator`` draws.

    That one searches a fold after the other. A fit is many short jobs over few partitions, so the folds are searched together.
    """
    drawn, parts = train.withColumn("__drawn", F.rand(seed)), []
    for i in range(folds):
        held = (F.col("__drawn") >= i * (1.0 / folds)) & (F.col("__drawn") < (i + 1) * (1.0 / folds))
        parts.append((drawn.filter(~held).persist(), drawn.filter(held).persist()))

    def score(at: tuple[int, dict]) -> float:
        rest, own = parts[at[0]]
        return MacroF1().evaluate(pipeline.fit(rest, at[1]).transform(own))

    try:
        with ThreadPoolExecutor(max_workers=folds * parallelism) as pool:
            found = list(pool.map(score, [(i, settings) for i in range(folds) for settings in grid]))
    finally:
        for rows in (rows for part in parts for rows in part):
            rows.unpersist()
    return [found[i * len(grid):(i + 1) * len(grid)] for i in range(folds)]


_trained: dict[tuple, MetaModel] = {}  # by application, rows and settings


def meta_train_shared(meta: DataFrame, grid: dict | None = None, folds: int = 5, seed: int = SEED, parallelism: int = 4) -> MetaModel:
    """The fitted model of ``meta_train``, kept for whoever asks in this application with the same rows, in any order, and settings.

    It is the model that was fitted: nothing is read in place of a training, and another application trains its own.
    """
    spark = meta.sparkSession
    row = F.xxhash64(*[quoted(c) for c in sorted(meta.columns)])
    about = meta.agg(F.count("*").alias("n"), F.bit_xor(row).alias("x"), F.sum(row.cast("decimal(38,0)")).cast("string").alias("s")).first()
    asked = json.dumps([about["n"], about["x"], about["s"], sorted(meta.columns), grid or GRID, folds, seed], sort_keys=True)
    key = spark.sparkContext.applicationId, asked
    if key not in _trained:
        _trained[key] = meta_train(meta, grid, folds, seed, parallelism)
    return _trained[key]


def _file_system(spark: SparkSession, path: str):
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder, folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _exists(spark: SparkSession, path: str) -> bool:
    folder, fs = _file_system(spark, path)
    return fs.exists(folder)


def _named(index: Column) -> Column:
    return F.element_at(F.array(*[F.lit(r) for r in RISK_LABELS]), index.cast("int") + 1)


def meta_evaluate(model: MetaModel) -> DataFrame:
    """Per-class report on the test rows."""
    return class_report(model.pipeline.transform(model.test)).select(
        _named(F.col("label")).alias("risk"), "support",
        *[F.round(m, 4).alias(m) for m in ("precision", "recall", "f1")])


def confusion_matrix(model: MetaModel) -> DataFrame:
    """Test rows per true (rows) and predicted (columns) label."""
    scored = model.pipeline.transform(model.test).select(
        _named(F.col("label")).alias("risk"), _named(F.col("prediction")).alias("predicted"))
    return scored.groupBy("risk").pivot("predicted", list(RISK_LABELS)).count().na.fill(0)


def train_test_gap(model: MetaModel, limit: float = 0.15) -> DataFrame:
    """One row: accuracy on training and test rows, the gap, and whether it hints at overfitting."""
    def accuracy(rows: DataFrame, label: str) -> DataFrame:
        hit = F.when(F.col("prediction") == F.col("label"), 1.0).otherwise(0.0)
        return model.pipeline.transform(rows).agg(F.avg(hit).alias(label))

    both = accuracy(model.train, "train_acc").crossJoin(F.broadcast(accuracy(model.test, "test_acc")))  # one row each
    gap = F.col("train_acc") - F.col("test_acc")
    return both.select("train_acc", "test_acc", F.round(gap, 4).alias("gap"), (gap > limit).alias("possible_overfit"))


def feature_importance(spark: SparkSession, pipeline: PipelineModel) -> DataFrame:
    """``feature, importance``, largest first."""
    values = pipeline.stages[-1].featureImportances.toArray()
    rows = [(f, float(v)) for f, v in zip(META_FEATURES, values)]
    return local_rows(spark, rows, "feature string, importance double").orderBy(F.desc("importance"), "feature")


def save_model(pipeline: PipelineModel, path: str) -> None:
    pipeline.write().overwrite().save(path)


def load_model(spark: SparkSession, path: str) -> PipelineModel:
    """The saved model; a clear error where there is none."""
    if not _exists(spark, path):
        raise FileNotFoundError(f"no model at {path}; train and save one first")
    return PipelineModel.load(path)


def predict_risk(pipeline: PipelineModel, df: DataFrame, target: str) -> DataFrame:
    """One row: the ten meta-features of a dataset and its predicted risk."""
    scored = pipeline.transform(meta_features(df, target))
    return scored.select(*META_FEATURES, _named(F.col("prediction")).alias("predicted_risk"))
