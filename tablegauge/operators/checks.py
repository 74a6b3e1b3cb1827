"""Quality checks: projections and filters over a column profile."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablegauge.functions import keywords as K
from tablegauge.functions import names as N
from tablegauge.functions import rules as R
from tablegauge.functions.nulls import normalize_nulls
from tablegauge.functions.session import staged, together
from tablegauge.operators.correlation import correlations, pair_table
from tablegauge.operators.duplicates import duplicate_count
from tablegauge.operators.facts import collect_facts
from tablegauge.operators.profile import TableProfile


def check_missing(profile: TableProfile) -> DataFrame:
    """Columns with gaps, worst risk first, then the larger share."""
    risk = R.missing_risk(F.col("missing_pct"), F.col("importance"))
    return (
        profile.columns.filter("missing > 0")
        .select("ordinal", F.col("name").alias("col"), "missing", F.col("missing_pct").alias("pct"),
                risk.alias("risk"), "importance")
        .orderBy(R.severity_rank(F.col("risk")), F.desc("pct"), "ordinal")
    )


def check_duplicates(profile: TableProfile) -> DataFrame:
    return profile.overview.select(
        "duplicate_rows", "duplicate_pct", R.duplicate_risk(F.col("duplicate_pct")).alias("risk")
    )


def check_outliers(profile: TableProfile) -> DataFrame:
    """Numeric columns with a row outside the fences or beyond three standard deviations."""
    most = F.greatest("outliers_iqr", "outliers_zscore")
    n = F.lit(profile.facts.rows).cast("long")
    return profile.columns.filter((F.col("outliers_iqr") > 0) | (F.col("outliers_zscore") > 0)).select(
        "ordinal", F.col("name").alias("col"), F.col("outliers_iqr").alias("iqr_count"),
        F.col("outliers_zscore").alias("zscore_count"), R.outlier_risk(most, n).alias("risk"), "is_ordinal",
    )


def check_wrong_types(profile: TableProfile) -> DataFrame:
    return profile.columns.filter("suggested_dtype <> ''").select(
        "ordinal", F.col("name").alias("col"), F.col("dtype_raw").alias("current_type"),
        F.col("suggested_dtype").alias("suggested_type"),
    )


def _invalid(profile: TableProfile, words, counter: str) -> DataFrame:
    return (
        profile.raw.filter(F.col("dtype_class") == "numeric")
        .filter(N.contains_any(F.col("name"), words) & (F.col(counter) > 0))
        .select("ordinal", F.col("name").alias("col"), F.col(counter).alias("count"))
    )


def check_negative_invalid(profile: TableProfile) -> DataFrame:
    """Negative values in columns whose name says they cannot be negative."""
    return _invalid(profile, K.NEGATIVE_INVALID_WORDS, "negatives")


def check_zero_invalid(profile: TableProfile) -> DataFrame:
    return _invalid(profile, K.ZERO_INVALID_WORDS, "zeros")


def check_skewness(profile: TableProfile) -> DataFrame:
    """Skewed numeric columns with more than ten distinct values; mild skew is not reported."""
    return (
        profile.columns.filter((F.col("dtype_class") == "numeric") & ~F.coalesce("is_ordinal", F.lit(False)))
        .filter(F.col("skewness").isNotNull())
        .select("ordinal", F.col("name").alias("col"), "skewness",
                R.skew_level(F.col("skewness")).alias("level"))
        .filter("level <> 'LOW'")
    )


def continuous_columns(profile: TableProfile) -> list[str]:
    """Numeric columns that take part in the correlation check."""
    return [c.name for c in profile.facts.columns if c.numeric and not (c.has_stats and c.ordinal_like)]


def correlation_pairs(df: DataFrame, profile: TableProfile) -> DataFrame:
    """``(col1, col2, position, r)`` of all continuous pairs, unrounded."""
    return pair_table(normalize_nulls(df), continuous_columns(profile))


def correlation_bands(pairs: DataFrame) -> DataFrame:
    """Pairs worth reporting: band from the unrounded r, r shown with three decimals."""
    return (
        pairs.select("position", "col1", "col2", R.correlation_band(F.col("r")).alias("band"),
                     F.round("r", 3).alias("correlation"))
        .filter(F.col("band").isNotNull())
    )


def flag_high_cv(profile: TableProfile) -> DataFrame:
    """Columns whose spread is more than twice their mean, a hint of drift."""
    return profile.columns.filter("cv > 2").select("ordinal", F.col("name").alias("col"), "cv")


def flag_high_cardinality(profile: TableProfile) -> DataFrame:
    """Text columns in which more than 85 % of the rows differ."""
    ratio = F.try_divide("unique", F.lit(profile.facts.rows))
    return profile.columns.filter(F.col("dtype_class") == "categorical").filter(
        ratio > K.ID_DISTINCT_RATIO
    ).select("ordinal", F.col("name").alias("col"), "unique", "unique_pct")


def column_flags(profile: TableProfile) -> DataFrame:
    """Constant, high-cardinality and type flags per column, and whether it needs a review."""
    ratio = F.coalesce(F.try_divide("unique", F.lit(profile.facts.rows)), F.lit(0.0))
    high = (F.col("dtype_class") == "categorical") & (ratio > K.ID_DISTINCT_RATIO)
    mismatch = F.col("suggested_dtype") != ""
    outliers = F.coalesce(F.greatest("outliers_iqr", "outliers_zscore"), F.lit(0))
    flagged = F.col("is_constant") | high | mismatch | (F.col("missing") > 0) | (outliers > 0)
    return profile.columns.select(
        "ordinal", F.col("name").alias("col"), F.col("dtype_class").alias("dtype"), "missing", "missing_pct",
        outliers.cast("long").alias("outliers"), "skewness", F.col("is_constant").alias("constant"),
        high.alias("high_cardinality"), mismatch.alias("type_mismatch"),
        F.when(flagged, "review").otherwise("ok").alias("status"),
    )


class TableChecks:
    """All checks of one table, each a small DataFrame, computed from the profile when asked for."""

    def __init__(self, df: DataFrame, profile: TableProfile, pairs: DataFrame | None = None):
        self.profile = profile
        self._df, self._pairs = df, pairs

    missing = cached_property(lambda self: check_missing(self.profile))
    duplicates = cached_property(lambda self: check_duplicates(self.profile))
    outliers = cached_property(lambda self: check_outliers(self.profile))
    wrong_types = cached_property(lambda self: check_wrong_types(self.profile))
    negative_invalid = cached_property(lambda self: check_negative_invalid(self.profile))
    zero_invalid = cached_property(lambda self: check_zero_invalid(self.profile))
    skewness = cached_property(lambda self: check_skewness(self.profile))

    @cached_property
    def pairs(self) -> DataFrame:
        return self._pairs if self._pairs is not None else correlation_pairs(self._df, self.profile)

    @cached_property
    def correlation(self) -> DataFrame:
        return correlation_bands(self.pairs)


def check_table(df: DataFrame, target: str | None = None) -> TableChecks:
    """Profile the table and prepare its checks, reading a small input from memory."""
    df = normalize_nulls(df)
    with staged(df) as rows:
        facts, copies = together([lambda: collect_facts(rows), lambda: duplicate_count(rows).first()[0]])
        profile = TableProfile(df, facts, target, copies)
        pairs = correlation_pairs(rows, profile)
    return TableChecks(df, profile, pairs)


def target_correlation(df: DataFrame, target: str) -> DataFrame:
    """``|r|`` of each numeric column that is not an identifier with a numeric target."""
    from tablegauge.functions.session import local_rows
    from tablegauge.operators.profile import profile_table

    profile = profile_table(df, target, quartiles=False, duplicates=False)
    names = [c.name for c in profile.facts.columns
             if c.numeric and c.name != target and not profile.facts.id_like(c)]
    found = correlations(normalize_nulls(df), [(c, target) for c in names])
    rows = [(c, r) for (c, _), r in found.items() if r is not None]
    return local_rows(df.sparkSession, rows, "col string, r double").select(
        "col", F.round(F.abs("r"), 3).alias("abs_correlation")
    )
