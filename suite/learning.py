"""Queries on meta-features, labels, baseline and the risk model."""

from __future__ import annotations

import json
import math
from functools import reduce
from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from suite import sqltext as S
from suite.views import table, with_views
from tablegauge.functions.rules import RISK_LABELS, risk_label
from tablegauge.functions.session import checkpointed, fresh_path, local_rows
from tablegauge.operators import learn as N
from tablegauge.operators import meta as M

QUERIES, ORACLES = {}, {}
FEAT, TARGET = "lineitem_feat", "l_returnflag"


def query(name: str, oracle: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn

    return add


# The ten numbers in SQL.

_NUM = S.names(FEAT, "numeric")
_ALL = S.names(FEAT)


def _mean_of(parts: list[str]) -> str:
    return "(select round(coalesce(avg(v), 0), 4) from (" + " union all ".join(f"select {p} as v from {FEAT}" for p in parts) + "))"


def _g1(c: str) -> str:
    return (f"select case when min(x) = max(x) then null else abs(avg(pow(x - m, 3)) / pow(avg(pow(x - m, 2)), 1.5)) end as v "
            f"from (select {c} as x, avg({c}) over () as m from {FEAT} where {c} is not null)")


_VARIANCE = _mean_of([f"var_samp({c})" for c in _NUM])
_CORRELATION = _mean_of([f"abs({S.corr(a, b)})" for a, b in combinations(_NUM, 2)])
_SKEWNESS = "(select round(coalesce(avg(v), 0), 4) from (" + " union all ".join(_g1(c) for c in _NUM) + "))"
_IMBALANCE = f"(select round(max(n)::double / sum(n), 4) from (select count(*) as n from {FEAT} where {TARGET} is not null group by {TARGET}))"
_MISSING = "round((" + " + ".join(f"count(*) - count({c})" for c in _ALL if c != TARGET) + f")::double / (count(*) * {len(_ALL) - 1}), 4)"
_DUPLICATES = f"round((count(*) - (select count(*) from (select distinct * from {FEAT})))::double / count(*), 4)"
_FENCES = "fences as (select " + ", ".join(
    f"quantile_cont({c}, 0.25) as a_{c}, quantile_cont({c}, 0.75) as b_{c}" for c in _NUM) + f" from {FEAT})"
_OUTLIERS = (f"(select round(count(*) filter (where " + " or ".join(
    f"(b_{c} <> a_{c} and ({c} < a_{c} - 1.5 * (b_{c} - a_{c}) or {c} > b_{c} + 1.5 * (b_{c} - a_{c})))" for c in _NUM) +
    f")::double / count(*), 4) from {FEAT}, fences)")
_WITH = with_views(FEAT).rstrip() + ", " + _FENCES + " "
META_SQL = (_WITH + f"select count(*) as n_samples, {len(_ALL) - 1}::bigint as n_features, "
            f"round({len(_ALL) - 1}::double / count(*), 6) as ratio, {_VARIANCE} as variance, {_CORRELATION} as correlation, "
            f"{_IMBALANCE} as imbalance, {_MISSING} as missing, {_SKEWNESS} as skewness, {_DUPLICATES} as duplicate_pct, "
            f"{_OUTLIERS} as outlier_pct from {FEAT}")


def _feat(spark, sf):
    return table(spark, sf, FEAT)


@query("mf_shape", _WITH + f"select count(*) as n_samples, 8::bigint as n_features, round(8::double / count(*), 6) as ratio from {FEAT}")
def mf_shape(spark, sf):
    return M.mf_shape(_feat(spark, sf), TARGET)


@query("mf_variance", _WITH + f"select {_VARIANCE} as variance")
def mf_variance(spark, sf):
    return M.mf_variance(_feat(spark, sf), TARGET)


@query("mf_correlation", _WITH + f"select {_CORRELATION} as correlation")
def mf_correlation(spark, sf):
    return M.mf_correlation(_feat(spark, sf), TARGET)


@query("mf_imbalance", _WITH + f"select {_IMBALANCE} as imbalance")
def mf_imbalance(spark, sf):
    return M.mf_imbalance(_feat(spark, sf), TARGET)


@query("mf_missing", _WITH + f"select {_MISSING} as missing from {FEAT}")
def mf_missing(spark, sf):
    return M.mf_missing(_feat(spark, sf), TARGET)


@query("mf_skewness", _WITH + f"select {_SKEWNESS} as skewness")
def mf_skewness(spark, sf):
    return M.mf_skewness(_feat(spark, sf), TARGET)


@query("mf_duplicate_pct", with_views("orders_dirty") + "select round((count(*) - (select count(*) from (select distinct * from orders_dirty)))"
       "::double / count(*), 4) as duplicate_pct from orders_dirty")
def mf_duplicate_pct(spark, sf):
    return M.mf_duplicate_pct(table(spark, sf, "orders_dirty"))


@query("mf_outlier_pct", _WITH + f"select {_OUTLIERS} as outlier_pct")
def mf_outlier_pct(spark, sf):
    return M.mf_outlier_pct(_feat(spark, sf), TARGET)


@query("meta_features", META_SQL)
def meta_features(spark, sf):
    return M.meta_features(_feat(spark, sf), TARGET)


# Many datasets in one table.

_SNUM = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "by_size", "by_line"]


def _by_slice() -> str:
    stats = ", ".join(
        f"var_samp({c}) as v_{c}, quantile_cont({c}, 0.25) as a_{c}, quantile_cont({c}, 0.75) as b_{c}, avg({c}) as m_{c}"
        for c in _SNUM)
    rs = ", ".join(f"abs({S.corr(a, b)}) as r_{i}" for i, (a, b) in enumerate(combinations(_SNUM, 2)))
    n_pairs = len(list(combinations(_SNUM, 2)))
    gaps = " + ".join(f"count(*) - count({c})" for c in _SNUM)
    skews = ", ".join(
        f"case when min({c}) = max({c}) then null else abs(avg(pow({c} - m_{c}, 3)) / pow(avg(pow({c} - m_{c}, 2)), 1.5)) end as g_{c}"
        for c in _SNUM)
    out = " or ".join(f"(b_{c} <> a_{c} and ({c} < a_{c} - 1.5 * (b_{c} - a_{c}) or {c} > b_{c} + 1.5 * (b_{c} - a_{c})))" for c in _SNUM)
    return with_views("slices").rstrip() + f""",
      st as (select slice as s, count(*) as n, {gaps} as gaps, {stats}, {rs} from slices group by slice),
      sk as (select slice as k, count(*) filter (where {out}) as flagged, {skews} from slices join st on s = slice group by slice),
      im as (select slice as i, max(n)::double / sum(n) as imbalance from (select slice, target, count(*) as n from slices
             where target is not null group by 1, 2) group by 1),
      du as (select slice as d, count(*) as kept from (select distinct * from slices) group by 1)
      select s as slice, n as n_samples, {len(_SNUM)}::bigint as n_features, round({len(_SNUM)}::double / n, 6) as ratio,
        round(list_avg([{', '.join(f'v_{c}' for c in _SNUM)}]), 4) as variance,
        round(coalesce(list_avg([{', '.join(f'r_{i}' for i in range(n_pairs))}]), 0), 4) as correlation,
        round(imbalance, 4) as imbalance, round(gaps::double / (n * {len(_SNUM)}), 4) as missing,
        round(coalesce(list_avg([{', '.join(f'g_{c}' for c in _SNUM)}]), 0), 4) as skewness,
        round((n - kept)::double / n, 4) as duplicate_pct, round(flagged::double / n, 4) as outlier_pct
      from st join sk on k = s join im on i = s join du on d = s"""


@query("meta_features_by", _by_slice())
def meta_features_by(spark, sf):
    return M.meta_features_by(table(spark, sf, "slices"), ["slice"], "target")


# Labels, split, baseline.

@query("encode_labels", with_views("orders_dirty") + "select o_orderkey, ship_priority as label, dense_rank() over (order by p) - 1 as ship_priority "
       "from (select *, coalesce(ship_priority, 'nan') as p from orders_dirty)")
def encode_labels(spark, sf):
    df = table(spark, sf, "orders_dirty").select("o_orderkey", "ship_priority", F.col("ship_priority").alias("label"))
    return N.encode_labels(df, ["ship_priority"])


_TEXTS = ("o_orderstatus", "ship_priority", "comment", "order_date", "net_total", "schema_tag")


@query("encode_labels_all", with_views("orders_dirty") + "select o_orderkey, " + ", ".join(
    f"dense_rank() over (order by coalesce({c}, 'nan')) - 1 as {c}" for c in _TEXTS) + " from orders_dirty")
def encode_labels_all(spark, sf):
    """Every text column of the table, with very many classes among them."""
    return N.encode_labels(table(spark, sf, "orders_dirty").select("o_orderkey", *_TEXTS), list(_TEXTS))


@query("split_train_test", """with u as (select o_orderkey, o_orderstatus,
      ('0x' || substr(md5(concat_ws('|', o_orderkey::varchar, '42')), 1, 13))::bigint as u from orders),
    k as (select o_orderstatus as c, count(*) as n, sum(count(*)) over () as total from u group by 1),
    e as (select c, n, ceil(0.3 * total) as tests, ceil(0.3 * total) * n / total as want from k),
    f as (select c, floor(want) as base, row_number() over (order by floor(want) - want, c) as place,
          tests - sum(floor(want)) over () as rest from e),
    z as (select c, base + case when place <= rest then 1 else 0 end as size from f)
    select o_orderkey, o_orderstatus, row_number() over (partition by o_orderstatus order by u) <= size as is_test
    from u join z on c = o_orderstatus""")
def split_train_test(spark, sf):
    rows = N.split_train_test(table(spark, sf, "orders"), "o_orderstatus", 0.3, key=["o_orderkey"])
    return rows.select("o_orderkey", "o_orderstatus", "is_test")


@query("baseline_eval_values")
def baseline_eval_values(spark, sf):
    return N.baseline_eval(table(spark, sf, "orders_dirty"), "o_orderstatus")


@query("baseline_eval", with_views("orders_dirty").rstrip() + """, classes as (
    select row_number() over (order by o_orderstatus) - 1 as label, count(*) as k, sum(count(*)) over () as n, ceil(0.3::double * sum(count(*)) over ()) as total
    from orders_dirty where o_orderstatus is not null group by o_orderstatus),
  parts as (select *, floor(total * k / n) as whole, row_number() over (order by floor(total * k / n) - total * k / n, label) as place from classes),
  sizes as (select label, k, whole + case when place <= total - sum(whole) over () then 1 else 0 end as test_rows from parts)
  select label::double as label, (k - test_rows)::bigint as train_rows, test_rows::bigint as test_rows, true as shares_fit, true as gap_fits from sizes""")
def baseline_eval(spark, sf):
    """Rows of each class on both sides; the accuracies are the shares of rows predicted right, and the gap is their difference."""
    scored = checkpointed(N.scored_baseline(table(spark, sf, "orders_dirty"), "o_orderstatus").select("label", "prediction", "is_test"))
    c, right = F.col, F.col("prediction") == F.col("label")
    accuracy = N.accuracies(scored)
    # By another way: counts instead of means.
    counts = scored.agg(*[F.round(F.count_if(right & side) / F.count_if(side), 4).alias(name) for name, side in (("a", ~c("is_test")), ("b", c("is_test")))])
    checks = accuracy.crossJoin(counts).select(((c("train_acc") == c("a")) & (c("test_acc") == c("b"))).alias("shares_fit"), (F.abs(c("train_acc") - c("test_acc") - c("gap")) <= 1e-4).alias("gap_fits"))
    sides = scored.groupBy("label").agg(F.count_if(~c("is_test")).alias("train_rows"), F.count_if("is_test").alias("test_rows"))
    return sides.crossJoin(checks).select("label", "train_rows", "test_rows", "shares_fit", "gap_fits")  # one row of checks


@query("baseline_eval_known", "select 1.0::double as train_acc, 1.0::double as test_acc, 0.0::double as gap from orders limit 1")
def baseline_eval_known(spark, sf):
    """A target that one column decides, so the accuracy is known beforehand."""
    rows = table(spark, sf, "orders").select("o_custkey", F.when(F.col("o_orderkey") % 2 == 0, 10.0).otherwise(-10.0).alias("side"))
    return N.baseline_eval(rows.withColumn("target", F.when(F.col("side") > 0, "up").otherwise("down")), "target")


_ACC = ("round(avg(case when l_quantity > 20 then 1.0 else 0.0 end), 4)::double as train_acc, "
        "round(avg(case when l_quantity > 30 then 1.0 else 0.0 end), 4)::double as test_acc, count(*) as n_samples, "
        "round(avg(case when target in ('inner', 'large') then 1.0 else 0.0 end), 4)::double as imbalance, "
        "round(avg(case when l_tax is null then 1.0 else 0.0 end), 4)::double as missing")


@query("risk_label", with_views("slices").rstrip() + f""", a as (select slice, {_ACC} from slices group by 1)
    select slice, case when round(train_acc - test_acc, 4) > 0.15 then 'Overfitting Risk'
      when imbalance > 0.85 and n_samples < 1000 then 'Overfitting Risk'
      when train_acc < 0.60 and test_acc < 0.60 then 'Underfitting Risk' when n_samples < 100 then 'Underfitting Risk'
      when missing > 0.30 then 'Underfitting Risk' else 'Safe Dataset' end as risk from a""")
def risk_label_(spark, sf):
    """The rule ladder over shares measured per slice, in place of accuracies."""
    c = F.col

    def share(test):
        return F.round(F.avg(F.when(test, 1.0).otherwise(0.0)), 4)

    rows = table(spark, sf, "slices").groupBy("slice").agg(
        share(c("l_quantity") > 20).alias("train_acc"), share(c("l_quantity") > 30).alias("test_acc"),
        F.count("*").alias("n_samples"), share(c("target").isin("inner", "large")).alias("imbalance"),
        share(c("l_tax").isNull()).alias("missing"))
    gap = F.round(c("train_acc") - c("test_acc"), 4)
    return rows.select("slice", risk_label(c("train_acc"), c("test_acc"), gap, c("n_samples"), c("imbalance"), c("missing")).alias("risk"))


@query("meta_schema_guard", _WITH + f"select count(*) as n_samples, {_MISSING} as missing, 'lacks outlier_pct' as refused from {FEAT}")
def meta_schema_guard(spark, sf):
    """The full row passes; without one of its columns it is refused."""
    row = N.meta_schema_guard(_mini(spark, sf))
    try:
        N.meta_schema_guard(row.drop("outlier_pct"))
        refused = "nothing"
    except ValueError as exc:
        refused = "lacks " + str(exc).split("'")[1]
    return row.select("n_samples", "missing", F.lit(refused).alias("refused"))


def _mini(spark, sf):
    return M.meta_features(_feat(spark, sf), TARGET)


def _datasets(spark, sf):
    """Several given tables as datasets, each with one of its columns as target."""
    tables = {
        "orders": table(spark, sf, "orders_dirty").withColumnRenamed("o_orderstatus", "target"),
        "lineitem": _feat(spark, sf).withColumnRenamed(TARGET, "target"),
        "labels": table(spark, sf, "labels").withColumnRenamed("toxic", "target"),
        "customer": table(spark, sf, "customer"),
    }
    found, skipped = N.meta_dataset(spark, tables)
    return found.unionByName(skipped.select("table_name"), allowMissingColumns=True)


@query("meta_dataset_values")
def meta_dataset_values(spark, sf):
    return _datasets(spark, sf)


@query("meta_dataset", with_views("orders_dirty", FEAT) + f"""select 'orders' as table_name, count(*) as n_samples, {len(S.names("orders_dirty")) - 1}::bigint as n_features, true as labelled from orders_dirty
    union all select 'lineitem', count(*), {len(_ALL) - 1}, true from {FEAT}
    union all select 'labels', count(*), (select count(*) - 1 from (describe labels)), true from labels union all select 'customer', null, null, false""")
def meta_dataset(spark, sf):
    """Size of each dataset and whether it has a risk label; a table without the target is passed over."""
    return _datasets(spark, sf).select("table_name", "n_samples", "n_features", F.coalesce(F.col("risk").isin(*RISK_LABELS), F.lit(False)).alias("labelled"))


@query("meta_dataset_by")
def meta_dataset_by(spark, sf):
    return _slices(spark, sf)


_rows_of: dict[tuple[str, str], DataFrame] = {}  # by application and folder: seven queries ask for the same rows


def _slices(spark, sf):
    return N.meta_dataset_by(table(spark, sf, "slices"), ["slice"], "target")


def _rows(spark, sf):
    key = spark.sparkContext.applicationId, sf
    if key not in _rows_of:
        _rows_of[key] = checkpointed(_slices(spark, sf))
    return _rows_of[key]


def _model(spark, sf):
    """The model of all settings of the library, trained by the first query of an application that asks for it."""
    return N.meta_train_shared(_rows(spark, sf))


_SPLIT = with_views("slices").rstrip() + ", meta as (select count(distinct slice) as n, ceil(0.2::double * count(distinct slice))::bigint as held from slices) "


def _between(x, low=0.0, high=1.0):
    return F.coalesce((F.col(x) >= low) & (F.col(x) <= high), F.lit(False))


@query("meta_train_values")
def meta_train_values(spark, sf):
    """Every setting tried with mean and deviation of its F1, best first."""
    rows = [(json.dumps(r["settings"], sort_keys=True), r["mean"], r["deviation"]) for r in _model(spark, sf).scores]
    return local_rows(spark, rows, "settings string, mean_f1 double, deviation double").orderBy(F.desc("mean_f1"), "settings")


@query("meta_train", _SPLIT + f"select n - held as train_rows, held as test_rows, {math.prod(map(len, N.GRID.values()))}::bigint as settings, true as in_range, true as best_chosen from meta")
def meta_train(spark, sf):
    """Rows of both parts, the settings tried, whether their scores can be such, and whether the best of them was taken."""
    model = _model(spark, sf)
    counts = model.train.agg(F.count("*").alias("train_rows")).crossJoin(F.broadcast(model.test.agg(F.count("*").alias("test_rows"))))
    in_range = all(0 <= r["mean"] <= 1 and 0 <= r["deviation"] <= 0.5 for r in model.scores)
    forest = model.pipeline.stages[-1]
    taken = forest.getNumTrees == model.settings["numTrees"] and forest.getOrDefault("maxDepth") == model.settings["maxDepth"] and model.cv_f1 == max(r["mean"] for r in model.scores)
    return counts.select("train_rows", "test_rows", F.lit(len(model.scores)).cast("long").alias("settings"), F.lit(in_range).alias("in_range"), F.lit(taken).alias("best_chosen"))


@query("meta_evaluate_values")
def meta_evaluate_values(spark, sf):
    return N.meta_evaluate(_model(spark, sf))


@query("meta_evaluate", _SPLIT + "select held as support, held as in_matrix, true as in_range, true as recall_fits from meta")
def meta_evaluate(spark, sf):
    """Support of all classes, cells of the matrix, and whether the matrix gives the recall of the report."""
    model = _model(spark, sf)
    report, matrix = N.meta_evaluate(model), N.confusion_matrix(model)
    hit = reduce(lambda a, b: F.when(F.col("risk") == b, F.col(f"`{b}`")).otherwise(a), RISK_LABELS, F.lit(0))
    total = sum(F.col(f"`{r}`") for r in RISK_LABELS)
    both = report.join(matrix.select("risk", total.alias("cells"), F.round(hit / total, 4).alias("again")), "risk", "left")
    ranges = [_between(x) for x in ("precision", "recall", "f1")]
    fits = F.coalesce(F.col("again") == F.col("recall"), (F.col("support") == 0) & (F.col("recall") == 0))
    return both.agg(F.sum("support").alias("support"), F.sum("cells").alias("in_matrix"), F.bool_and(ranges[0] & ranges[1] & ranges[2]).alias("in_range"), F.bool_and(fits).alias("recall_fits"))


@query("train_test_gap")
def train_test_gap(spark, sf):
    return N.train_test_gap(_model(spark, sf))


@query("confusion_matrix")
def confusion_matrix(spark, sf):
    return N.confusion_matrix(_model(spark, sf))


@query("feature_importance_values")
def feature_importance_values(spark, sf):
    return N.feature_importance(spark, _model(spark, sf).pipeline)


@query("feature_importance", " union all ".join(f"select '{f}' as feature, 1.0::double as total, true as in_order" for f in M.META_FEATURES))
def feature_importance(spark, sf):
    """Every feature once, importances that sum to one, and largest first."""
    found = N.feature_importance(spark, _model(spark, sf).pipeline)
    values = [r["importance"] for r in found.collect()]  # ten rows
    in_order = values == sorted(values, reverse=True) and min(values) >= 0
    return found.select("feature", F.lit(round(sum(values), 6)).alias("total"), F.lit(in_order).alias("in_order"))


@query("model_save_load_values")
def model_save_load_values(spark, sf):
    """Predictions of the saved and reloaded model, next to those of the fitted one."""
    return _reloaded(spark, sf)


def _reloaded(spark, sf):
    model = N.meta_train(_rows(spark, sf))  # trained here, so that what is saved was fitted and never read
    path = fresh_path(spark, "model")
    N.save_model(model.pipeline, path)
    again = N.load_model(spark, path)
    a = model.pipeline.transform(model.test).select("slice", F.col("prediction").alias("fitted"), F.col("probability").alias("p"))
    b = again.transform(model.test).select("slice", F.col("prediction").alias("reloaded"), F.col("probability").alias("q"))
    return a.join(b, "slice").select("slice", "fitted", "reloaded", (F.col("p") == F.col("q")).alias("same"))


@query("model_save_load", _SPLIT + "select held as rows, held as same from meta")
def model_save_load(spark, sf):
    """Held-out rows, and those for which the reloaded model gives the same label with the same probabilities."""
    same = F.col("same") & (F.col("fitted") == F.col("reloaded"))
    return _reloaded(spark, sf).agg(F.count("*").alias("rows"), F.count_if(same).alias("same"))


@query("predict_risk_values")
def predict_risk_values(spark, sf):
    return N.predict_risk(_model(spark, sf).pipeline, _feat(spark, sf), TARGET)


@query("predict_risk", META_SQL.replace(" as outlier_pct from ", " as outlier_pct, true as labelled from "))
def predict_risk(spark, sf):
    """The features of a dataset, and whether it was given one of the labels."""
    found = N.predict_risk(_model(spark, sf).pipeline, _feat(spark, sf), TARGET)
    return found.select(*M.META_FEATURES, F.col("predicted_risk").isin(*RISK_LABELS).alias("labelled"))
