"""Ten numbers that sum up a dataset, alone or for many datasets at once."""

from __future__ import annotations

import math
from functools import reduce
from itertools import combinations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablegauge.functions import keywords as K
from tablegauge.functions.classes import dtype_class
from tablegauge.functions.failures import cannot_read
from tablegauge.functions.joins import joined_by_key
from tablegauge.functions.nulls import finite, normalize_nulls, quoted
from tablegauge.functions.session import checkpointed, local_rows, staged
from tablegauge.operators import packed as P
from tablegauge.operators.correlation import correlations, mean_abs_correlation_by, numeric_columns, varies
from tablegauge.operators.duplicates import duplicate_count
from tablegauge.operators.facts import TableFacts, collect_facts, outside
from tablegauge.operators.quantiles import quantiles
from tablegauge.operators.ranks import grouped_quantiles

# Feature names in model order, and their shown digits.
META_FEATURES = (
    "n_samples", "n_features", "ratio", "variance", "correlation",
    "imbalance", "missing", "skewness", "duplicate_pct", "outlier_pct",
)
DIGITS = {"ratio": 6}
META_SCHEMA = "n_samples long, n_features long, " + ", ".join(f"{f} double" for f in META_FEATURES[2:])


def _shown(df: DataFrame, *before: str) -> DataFrame:
    return df.select(*before, "n_samples", "n_features",
                     *[F.round(f, DIGITS.get(f, 4)).alias(f) for f in META_FEATURES[2:]])


def _mean(values: list[float | None]) -> float:
    known = [v for v in values if v is not None and not math.isnan(v)]
    mean = sum(known) / len(known) if known else 0.0
    return mean if math.isfinite(mean) else 0.0


def _require(df: DataFrame, target: str) -> None:
    if target not in df.columns:
        raise ValueError(f"target column {target!r} not found; columns are {df.columns}")


def mf_shape(df: DataFrame, target: str) -> DataFrame:
    """One row: samples, features, features per sample."""
    _require(df, target)
    width = len(df.columns) - 1
    got = df.agg(F.count("*").alias("n_samples"))
    ratio = F.coalesce(F.try_divide(F.lit(width), F.col("n_samples")), F.lit(0.0))
    return got.select("n_samples", F.lit(width).cast("long").alias("n_features"), F.round(ratio, 6).alias("ratio"))


def mf_imbalance(df: DataFrame, target: str) -> DataFrame:
    """One row: share of the largest class among the non-null targets; 1 without any."""
    counts = normalize_nulls(df).select(quoted(target).alias("t")).dropna().groupBy("t").agg(F.count("*").alias("n"))
    return counts.agg(F.round(F.coalesce(F.max("n") / F.sum("n"), F.lit(1.0)), 4).alias("imbalance"))


def mf_missing(df: DataFrame, target: str) -> DataFrame:
    """One row: share of missing feature cells."""
    from tablegauge.operators.profile import missing_cells

    cells = missing_cells(df.drop(target))
    share = F.coalesce(F.try_divide("missing_cells", "total_cells"), F.lit(0.0))
    return cells.select(F.round(share, 4).alias("missing"))


def mf_duplicate_pct(df: DataFrame) -> DataFrame:
    """One row: share of rows equal to an earlier one, target included."""
    total = df.agg(F.count("*").alias("n")).crossJoin(F.broadcast(duplicate_count(df)))  # one row each
    return total.select(F.round(F.coalesce(F.try_divide("duplicate_rows", "n"), F.lit(0.0)), 4).alias("duplicate_pct"))


def mf_variance(df: DataFrame, target: str) -> DataFrame:
    """One row: mean sample variance of the numeric features."""
    names = numeric_columns(df.drop(target))
    return _mean_of(df, names, lambda x: F.var_samp(x), "variance")


def mf_skewness(df: DataFrame, target: str) -> DataFrame:
    """One row: mean |skewness| of the numeric features, undefined ones left out."""
    names = numeric_columns(df.drop(target))
    return _mean_of(df, names, lambda x: F.when(varies(x), F.abs(F.skewness(x))), "skewness")


def _mean_of(df: DataFrame, names: list[str], measure, label: str) -> DataFrame:
    df = normalize_nulls(df)
    cells = [finite(measure(quoted(c).cast("double"))) for c in names]
    got = df.agg(F.array(*cells).alias("m") if cells else F.array().cast("array<double>").alias("m"))
    known = F.filter("m", lambda v: v.isNotNull())
    total = F.aggregate(known, F.lit(0.0), lambda a, v: a + v)
    return got.select(F.round(F.coalesce(F.try_divide(total, F.size(known)), F.lit(0.0)), 4).alias(label))


def mf_correlation(df: DataFrame, target: str) -> DataFrame:
    """One row: mean |r| over the pairs of numeric features for which r is defined."""
    value = _mean_abs_r(normalize_nulls(df), numeric_columns(df.drop(target)))
    return local_rows(df.sparkSession, [(value,)], "r double").select(F.round("r", 4).alias("correlation"))


def _mean_abs_r(df: DataFrame, names: list[str]) -> float:
    found = correlations(df, list(combinations(names, 2)))
    return _mean([abs(r) for r in found.values() if r is not None])


def _outlier_share(df: DataFrame, facts: TableFacts, names: list[str]) -> float:
    chosen = [c for c in names if facts[c].present >= 4]
    if not chosen or not facts.rows:
        return 0.0
    exprs = {c: quoted(c).cast("double") for c in chosen}
    found = quantiles(df, exprs, [0.25, 0.75], {c: facts[c].present for c in chosen})
    flag = F.lit(False)
    for c in chosen:
        q1, q3 = found[c]
        if q3 != q1:
            reach = K.FENCE_FACTOR * (q3 - q1)
            flag = flag | F.coalesce(outside(exprs[c], q1 - reach, q3 + reach), F.lit(False))
    return df.agg(F.count_if(flag)).first()[0] / facts.rows


def mf_outlier_pct(df: DataFrame, target: str) -> DataFrame:
    """One row: share of rows outside the fences of any numeric feature."""
    df = normalize_nulls(df)
    names = numeric_columns(df.drop(target))
    facts = collect_facts(df.select([quoted(c) for c in names]), distinct="skip", quartiles=False, probes=False)
    share = _outlier_share(df, facts, names)
    return local_rows(df.sparkSession, [(share,)], "s double").select(F.round("s", 4).alias("outlier_pct"))


def meta_features(df: DataFrame, target: str) -> DataFrame:
    """One row with the ten meta-features."""
    _require(df, target)
    df = normalize_nulls(df)
    with staged(df) as rows:
        features = rows.drop(target)
        names = numeric_columns(features)
        facts = collect_facts(features, distinct="skip", quartiles=False, probes=False)
        n, width = facts.rows, len(features.columns)
        counts = rows.select(quoted(target).alias("t")).dropna().groupBy("t").agg(F.count("*").alias("n"))
        top = counts.agg(F.max("n").alias("top"), F.sum("n").alias("all")).first()
        varied = [c for c in facts.columns if c.has_stats]
        row = (
            n, width, width / n if n else 0.0,
            _mean([c.variance for c in varied]),
            _mean_abs_r(rows, names),
            top["top"] / top["all"] if top["all"] else 1.0,
            sum(n - c.present for c in facts.columns) / (n * width) if n * width else 0.0,
            _mean([abs(c.skewness) for c in varied if c.skewness is not None and c.minimum != c.maximum]) if n > 2 else 0.0,
            duplicate_count(rows).first()[0] / n if n else 0.0,
            _outlier_share(rows, facts, names),
        )
    return _shown(local_rows(df.sparkSession, [row], META_SCHEMA))


# Datasets with very many rows that are named to all tasks.
MOST_NAMED = 100_000


def meta_features_by(df: DataFrame, keys: list[str], target: str) -> DataFrame:
    """Meta-features of many datasets kept in one table: one row per combination of the keys.

    Rows of datasets with at most ``FEW_ROWS`` rows travel once (``packed_features``), unless a key is nested or binary. One of more rows may be arbitrarily
    large: each part is a grouped aggregate that combines on the map side, and the quartiles come from ``grouped_quantiles``.
    """
    df = normalize_nulls(df)
    features = [c for c in df.columns if c not in keys and c != target]
    names = [c for c in numeric_columns(df) if c in features]
    most = P.FEW_ROWS if all(dtype_class(df.schema[k].dataType) != "categorical" or df.schema[k].dataType.typeName() == "string" for k in keys) else 0
    sizes = checkpointed(df.groupBy(*keys).agg(F.count("*").alias("__n")))
    often = sizes.where(F.col("__n") > most)
    rows, large = sizes.agg(F.coalesce(F.sum("__n"), F.lit(0)), F.count_if(F.col("__n") > most)).first()
    few, many = df, None
    if large:
        named = often.select(*[quoted(k).alias(f"__key{i}") for i, k in enumerate(keys)], F.lit(True).alias("__often"))
        named = F.broadcast(named) if large <= MOST_NAMED else named.hint("merge")
        same = reduce(lambda a, b: a & b, [quoted(k).eqNullSafe(F.col(f"__key{i}")) for i, k in enumerate(keys)])
        marked = df.join(named, same, "left").drop(*[f"__key{i}" for i in range(len(keys))])
        few, many = marked.where("__often is null").drop("__often"), marked.where("__often").drop("__often")
    joined = P.packed_features(few, keys, features, names, target, rows)
    if many is not None:
        joined = joined.unionByName(_parts_by(many, keys, features, names, target))

    def mean(col: str):
        return F.coalesce(finite(F.col(col)), F.lit(0.0))

    n, width = F.col("n_samples"), len(features)
    zero = F.lit(0)
    return _shown(joined.select(
        *keys, n, F.lit(width).cast("long").alias("n_features"), (F.lit(width) / n).alias("ratio"),
        mean("variance").alias("variance"), mean("correlation").alias("correlation"),
        F.coalesce("imbalance", F.lit(1.0)).alias("imbalance"),
        (F.col("gaps") / (n * width)).alias("missing"),
        F.when(n > 2, mean("skewness")).otherwise(0.0).alias("skewness"),
        (F.coalesce("extra", zero) / n).alias("duplicate_pct"),
        (F.coalesce("flagged", zero) / n).alias("outlier_pct"),
    ), *keys)


def _parts_by(df: DataFrame, keys: list[str], features: list[str], names: list[str], target: str) -> DataFrame:
    """The same counts and means as ``packed_features`` for datasets of any size."""
    x = {c: quoted(c).cast("double") for c in names}
    gaps = F.lit(0).cast("long")
    for c in features:
        gaps = gaps + F.count_if(quoted(c).isNull())
    base = df.groupBy(*keys).agg(F.count("*").alias("n_samples"), gaps.alias("gaps"))
    # One row per dataset and column before the means over them; correlations come from matrices of each dataset.
    long = df.select(*keys, *[x[c].alias(c) for c in names]).unpivot(keys, names, "__column", "__value").filter(
        "__value is not null")
    v = F.col("__value")
    moments = long.groupBy(*keys, "__column").agg(
        F.var_samp(v).alias("var"), F.when(varies(v), F.abs(F.skewness(v))).alias("skew"))
    shape = moments.groupBy(*keys).agg(F.avg("var").alias("variance"), F.avg("skew").alias("skewness"))
    if len(names) > 1:
        related = mean_abs_correlation_by(df, keys, names)
    else:
        related = base.select(*keys, F.lit(0.0).alias("correlation"))
    classes = df.dropna(subset=[target]).groupBy(*keys, quoted(target).alias("__class")).agg(F.count("*").alias("n"))
    shares = classes.groupBy(*keys).agg((F.max("n") / F.sum("n")).alias("imbalance"))
    copies = duplicate_count(df, keys).withColumnRenamed("duplicate_rows", "extra")

    fences = grouped_quantiles(long, [*keys, "__column"], "__value", {"q1": 0.25, "q3": 0.75}).filter(
        (F.col("n") >= 4) & (F.col("q3") > F.col("q1")))
    reach = (F.col("q3") - F.col("q1")) * K.FENCE_FACTOR
    # Measured, and then joined.
    bounds = checkpointed(fences.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct(
        "__column", F.struct((F.col("q1") - reach).alias("low"), (F.col("q3") + reach).alias("high"))))).alias("bounds")))
    flag = F.lit(False)
    for c in names:
        bound = F.col("bounds")[c]
        flag = flag | F.coalesce((x[c] < bound.getField("low")) | (x[c] > bound.getField("high")), F.lit(False))
    flagged = joined_by_key(df, bounds, keys).groupBy(*keys).agg(F.count_if(flag).alias("flagged"))
    joined = base
    for part in (shape, related, shares, copies, flagged):
        joined = joined.join(part, keys, "left")
    return joined.select(*keys, *[c for c, _ in P.STATS])


def scan_list(spark: SparkSession, tables: dict, target: str, measure) -> tuple[DataFrame, DataFrame]:
    """``measure(name, table)`` for each table that has the target: results, and what was skipped.

    A table may be a DataFrame or a function that reads one. A table that cannot be read or
    measured is recorded and the others go on; if none succeeds, that is an error.
    """
    rows, skipped = [], []
    for name, source in tables.items():
        try:
            df = source() if callable(source) else source
            if target not in df.columns:
                skipped.append((name, "no target column"))
                continue
            rows.append(measure(name, df))
        except Exception as exc:  # one bad table must not end the run
            if not cannot_read(exc):
                raise
            skipped.append((name, str(exc).splitlines()[0][:500]))
    if not rows:
        raise RuntimeError(f"no table was processed: {skipped}")
    found = reduce(DataFrame.unionByName, rows)
    return found, local_rows(spark, skipped, "table_name string, error string")
