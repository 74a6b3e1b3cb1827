"""The transformations that the recommendations propose, DataFrame in and DataFrame out."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablegauge.functions.joins import joined_by_key
from tablegauge.functions.nulls import normalize_nulls, quoted
from tablegauge.functions.probes import parse_datetime_any, parse_number
from tablegauge.operators.correlation import correlations, numeric_columns, varies
from tablegauge.operators.quantiles import column_quantiles
from tablegauge.operators.readiness import class_counts
from tablegauge.functions import keywords as K


def fix_fill_constant(df: DataFrame, col: str, value: str = "Not Provided") -> DataFrame:
    return df.withColumn(col, F.coalesce(quoted(col), F.lit(value)))


def fix_drop_missing_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.dropna(subset=keys)


def fix_flag_present(df: DataFrame, col: str) -> DataFrame:
    """Adds ``has_<col>``: 1 where the column holds a value, else 0."""
    return df.withColumn(f"has_{col.lower()}", quoted(col).isNotNull().cast("int"))


def fix_fill_median(df: DataFrame, cols: list[str]) -> DataFrame:
    """Gaps become the exact, interpolated median of the column."""
    df = normalize_nulls(df)
    medians = column_quantiles(df, cols, [0.5])
    return df.withColumns({
        c: F.coalesce(quoted(c).cast("double"), F.lit(medians[c][0]).cast("double")) for c in cols
    })


def fix_fill_mode(df: DataFrame, col: str) -> DataFrame:
    """Gaps become the most frequent value, the smallest of several."""
    counted = df.select(quoted(col).alias("v")).dropna().groupBy("v").agg(F.count("*").alias("n"))
    best = counted.orderBy(F.desc("n"), "v").limit(1).select(F.col("v").alias("__mode"))
    mode = best.agg(F.first("__mode").alias("__mode"))  # one row, also for an empty column
    return (
        df.crossJoin(F.broadcast(mode))
        .withColumn(col, F.coalesce(quoted(col), F.col("__mode"))).drop("__mode")
    )


def fix_drop_sparse_columns(df: DataFrame, cols: list[str] | None = None, limit: float = 0.5) -> DataFrame:
    """Columns with more than half of their cells missing go; other numeric gaps become the median."""
    df = normalize_nulls(df)
    cols = df.columns if cols is None else cols
    row = df.agg(F.count("*").alias("n"), *[F.count(quoted(c)).alias(f"n{i}") for i, c in enumerate(cols)]).first()
    sparse = [c for i, c in enumerate(cols) if row["n"] and 1 - row[f"n{i}"] / row["n"] > limit]
    gappy = [c for i, c in enumerate(cols) if c not in sparse and row[f"n{i}"] < row["n"]]
    kept = df.drop(*sparse)
    numeric = [c for c in numeric_columns(kept) if c in gappy]
    return fix_fill_median(kept, numeric) if numeric else kept


def fix_drop_duplicates(df: DataFrame) -> DataFrame:
    return df.dropDuplicates()


def fix_clip_iqr(df: DataFrame, cols: list[str]) -> DataFrame:
    """Values beyond the fences become the fence; gaps stay gaps."""
    df = normalize_nulls(df)
    found = column_quantiles(df, cols, [0.25, 0.75])
    out = {}
    for c in cols:
        q1, q3 = found[c]
        x = quoted(c).cast("double")
        if q1 is not None:
            reach = K.FENCE_FACTOR * (q3 - q1)
            x = F.when(x < q1 - reach, q1 - reach).when(x > q3 + reach, q3 + reach).otherwise(x)
        out[c] = x
    return df.withColumns(out)


def fix_parse_datetime(df: DataFrame, cols: list[str]) -> DataFrame:
    """Text to timestamps; what does not parse becomes null."""
    return df.withColumns({c: parse_datetime_any(quoted(c)) for c in cols})


def fix_parse_numeric(df: DataFrame, cols: list[str]) -> DataFrame:
    """Text to doubles; what does not parse becomes null."""
    return df.withColumns({c: parse_number(quoted(c)) for c in cols})


def fix_log1p(df: DataFrame, cols: list[str]) -> DataFrame:
    """log(1 + x); null where x is not above -1."""
    return df.withColumns({c: F.when(quoted(c) > -1, F.log1p(quoted(c).cast("double"))) for c in cols})


def correlated_columns(df: DataFrame, limit: float = 0.9) -> list[str]:
    """The later column of every numeric pair with |r| above the limit."""
    names = numeric_columns(df)
    found = correlations(normalize_nulls(df), list(combinations(names, 2)))
    return [c for c in names if any(b == c and r is not None and abs(r) > limit for (_, b), r in found.items())]


def fix_drop_correlated(df: DataFrame, limit: float = 0.9) -> DataFrame:
    return df.drop(*correlated_columns(df, limit))


def fix_clip_negative(df: DataFrame, cols: list[str]) -> DataFrame:
    """Negative values become zero; gaps stay gaps."""
    return df.withColumns({c: F.when(quoted(c) < 0, F.lit(0)).otherwise(quoted(c)) for c in cols})


def fix_drop_negative(df: DataFrame, col: str) -> DataFrame:
    """Only rows with a value of zero or more."""
    return df.filter(quoted(col) >= 0)


def fix_class_weights(df: DataFrame, target: str, weight: str = "class_weight") -> DataFrame:
    """Adds the balanced weight n / (classes * rows of the class); null for a missing target."""
    counts = class_counts(df, target)
    total = counts.agg(F.sum("count").alias("n"), F.count("*").alias("k"))
    weights = counts.crossJoin(F.broadcast(total)).select(
        F.col("class").alias("__class"), (F.col("n") / (F.col("k") * F.col("count"))).alias(weight))
    keyed = normalize_nulls(df).withColumn("__class", quoted(target).cast("string"))
    return joined_by_key(keyed, weights, ["__class"], "left").drop("__class")


def fix_drop_leakage(df: DataFrame, cols: list[str]) -> DataFrame:
    return df.drop(*cols)


def fix_standardize(train: DataFrame, cols: list[str], also: list[DataFrame] = ()) -> list[DataFrame]:
    """(x - mean) / population deviation of the training rows, applied to train and the others."""
    clean = normalize_nulls(train)
    row = clean.agg(
        *[F.avg(quoted(c).cast("double")).alias(f"m{i}") for i, c in enumerate(cols)],
        *[F.when(varies(quoted(c)), F.stddev_pop(quoted(c).cast("double"))).alias(f"s{i}") for i, c in enumerate(cols)],
    ).first()
    out = []
    for df in (clean, *[normalize_nulls(d) for d in also]):
        scaled = {}
        for i, c in enumerate(cols):
            mean, spread = row[f"m{i}"], row[f"s{i}"]
            if mean is not None:
                scaled[c] = (quoted(c).cast("double") - mean) / (spread or 1.0)
        out.append(df.withColumns(scaled))
    return out
