"""Column profile and table overview as DataFrames, computed once and shared by all checks."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablegauge.functions import names as N
from tablegauge.functions import rules as R
from tablegauge.functions.nulls import finite, normalize_nulls, quoted
from tablegauge.functions.session import local_rows, staged, together
from tablegauge.operators.duplicates import duplicate_count
from tablegauge.operators.facts import TableFacts, collect_facts, logical_bytes

_FACT_SCHEMA = (
    "name string, ordinal int, dtype_raw string, dtype_class string, suggested_dtype string, "
    "present long, distinct long, mean double, median double, std double, variance double, "
    "minimum double, maximum double, q25 double, q75 double, skewness double, kurtosis double, "
    "outliers_iqr long, outliers_zscore long, negatives long, zeros long, "
    "top_value string, top_freq long, has_stats boolean, ordinal_like boolean"
)


class TableProfile:
    """What is known about one table. The DataFrames hold one row per column, or one row."""

    def __init__(self, df: DataFrame, facts: TableFacts, target: str | None, duplicates: int | None):
        self.spark = df.sparkSession
        self.facts = facts
        self.target = target
        self.duplicates = duplicates
        self._bytes = logical_bytes(df, facts)

    @cached_property
    def raw(self) -> DataFrame:
        """Unrounded facts, one row per column, plus the table's row count."""
        rows = []
        for c in self.facts.columns:
            q25, q50, q75 = c.quartiles
            rows.append((
                c.name, c.ordinal, c.dtype_raw, c.dtype_class, c.suggested, c.present, c.distinct,
                c.mean, q50, c.std, c.variance, c.minimum, c.maximum, q25, q75, c.skewness, c.kurtosis,
                c.outliers_iqr, c.outliers_zscore, c.negatives, c.zeros, c.top_value, c.top_freq,
                c.has_stats, c.ordinal_like,
            ))
        n = F.lit(self.facts.rows).cast("long")
        return local_rows(self.spark, rows, _FACT_SCHEMA).withColumn("n_rows", n)

    @cached_property
    def columns(self) -> DataFrame:
        """The column profile: 26 fields per column, in table order (``ordinal`` keeps it)."""
        if not self.facts.rows:
            return self._shaped().limit(0)
        return self._shaped()

    def _shaped(self) -> DataFrame:
        c = F.col
        name, n = c("name"), c("n_rows")
        id_like = N.is_id_like(name, c("distinct"), n)
        other = F.lit(True) if self.target is None else name != F.lit(self.target)
        stats = c("has_stats")
        text = (c("dtype_class") == "categorical") & (c("present") > 0)

        def stat(x: Column) -> Column:
            return F.when(stats, F.round(finite(x), 4))

        return self.raw.select(
            "name", "ordinal", "dtype_raw", "dtype_class", "suggested_dtype",
            (n - c("present")).alias("missing"),
            R.percent(n - c("present"), n).alias("missing_pct"),
            c("distinct").alias("unique"),
            R.percent(c("distinct"), n).alias("unique_pct"),
            id_like.alias("is_id_like"),
            (c("distinct") <= 1).alias("is_constant"),
            (~id_like & other & N.few_distinct(c("distinct"), n)).alias("is_target_candidate"),
            N.column_importance(name, self.target).alias("importance"),
            stat(c("mean")).alias("mean"), stat(c("median")).alias("median"),
            stat(c("std")).alias("std"), stat(c("minimum")).alias("min"), stat(c("maximum")).alias("max"),
            stat(c("q25")).alias("q25"), stat(c("q75")).alias("q75"),
            stat(c("skewness")).alias("skewness"), stat(c("kurtosis")).alias("kurtosis"),
            F.when(stats, c("outliers_iqr")).alias("outliers_iqr"),
            F.when(stats, c("outliers_zscore")).alias("outliers_zscore"),
            stat(F.abs(F.try_divide(c("std"), c("mean")))).alias("cv"),
            F.when(stats, c("ordinal_like")).alias("is_ordinal"),
            F.when(text, c("top_value")).alias("top_value"),
            F.when(text, c("top_freq")).alias("top_freq"),
            F.when(text, R.percent(c("top_freq"), c("present"))).alias("top_freq_pct"),
        )

    @cached_property
    def overview(self) -> DataFrame:
        """One row of twelve facts; no row for an empty table."""
        f = self.facts
        if not f.rows:
            return local_rows(self.spark, [], _OVERVIEW_RAW).select(*_overview_fields())
        classes = [c.dtype_class for c in f.columns]
        row = (
            f.rows, len(f.columns), self._bytes, classes.count("numeric"), classes.count("categorical"),
            classes.count("datetime"), self.duplicates, sum(f.rows - c.present for c in f.columns),
            f.complete_rows,
        )
        return local_rows(self.spark, [row], _OVERVIEW_RAW).select(*_overview_fields())


_OVERVIEW_RAW = (
    "rows long, columns long, bytes long, numeric_cols long, categorical_cols long, datetime_cols long, "
    "duplicate_rows long, missing_cells long, complete_rows long"
)


def _overview_fields() -> list:
    c = F.col
    return [
        "rows", "columns", F.round(c("bytes") / 1e6, 3).alias("data_mb"),
        "numeric_cols", "categorical_cols", "datetime_cols", "duplicate_rows",
        R.percent(c("duplicate_rows"), c("rows")).alias("duplicate_pct"),
        "missing_cells",
        R.percent(c("missing_cells"), c("rows") * c("columns")).alias("missing_pct"),
        "complete_rows", R.percent(c("complete_rows"), c("rows")).alias("complete_rows_pct"),
    ]


def profile_table(
    df: DataFrame,
    target: str | None = None,
    *,
    distinct: str = "exact",
    quartiles: bool | str = True,
    duplicates: bool = True,
) -> TableProfile:
    """Run the passes over ``df`` and return its profile."""
    df = normalize_nulls(df)
    with staged(df) as rows:
        facts, copies = together([
            lambda: collect_facts(rows, distinct=distinct, quartiles=quartiles),
            lambda: duplicate_count(rows).first()[0] if duplicates else None,
        ])
    return TableProfile(df, facts, target, copies)


def column_profile(df: DataFrame, target: str | None = None) -> DataFrame:
    """One row per column with every profile field."""
    return profile_table(df, target, duplicates=False).columns


def table_overview(df: DataFrame) -> DataFrame:
    return profile_table(df, quartiles=False).overview


# Single facts that need one plain pass only stay lazy.

def per_column(df: DataFrame, names: list[str], **measures) -> DataFrame:
    """One row per column: ``name`` and each measure, a function from column to aggregate."""
    df = normalize_nulls(df)
    aggs, rows = [], []
    for i, c in enumerate(names):
        x = quoted(c)
        aggs += [m(x).alias(f"{label}__{i}") for label, m in measures.items()]
        rows.append(F.struct(F.lit(c).alias("name"), *[F.col(f"{label}__{i}").alias(label) for label in measures]))
    return df.agg(F.count("*").alias("n_rows"), *aggs).select("n_rows", F.inline(F.array(*rows)))


def missing_by_column(df: DataFrame) -> DataFrame:
    """``name, missing, missing_pct``."""
    got = per_column(df, df.columns, missing=lambda x: F.count_if(x.isNull()))
    return got.select("name", "missing", R.percent(F.col("missing"), F.col("n_rows")).alias("missing_pct"))


def missing_cells(df: DataFrame) -> DataFrame:
    """One row: ``missing_cells, total_cells, missing_pct``."""
    df = normalize_nulls(df)
    gaps = F.lit(0).cast("long")
    for c in df.columns:
        gaps = gaps + F.count_if(quoted(c).isNull())
    return (
        df.agg(gaps.alias("missing_cells"), (F.count("*") * len(df.columns)).alias("total_cells"))
        .withColumn("missing_pct", R.percent(F.col("missing_cells"), F.col("total_cells")))
    )


def complete_rows(df: DataFrame) -> DataFrame:
    """One row: rows without any missing cell, and their share."""
    df = normalize_nulls(df)
    whole = F.lit(True)
    for c in df.columns:
        whole = whole & quoted(c).isNotNull()
    got = df.agg(F.count("*").alias("rows"), F.count_if(whole).alias("complete_rows"))
    return got.withColumn("complete_rows_pct", R.percent(F.col("complete_rows"), F.col("rows")))


def table_shape(df: DataFrame) -> DataFrame:
    """One row: rows, columns, and columns per class."""
    from tablegauge.functions.classes import columns_of

    return df.agg(F.count("*").alias("rows")).select(
        "rows", F.lit(len(df.columns)).cast("long").alias("columns"),
        *[F.lit(len(columns_of(df, cls))).cast("long").alias(f"{cls}_cols")
          for cls in ("numeric", "categorical", "datetime")],
    )


def memory_estimate(df: DataFrame) -> DataFrame:
    """One row: ``data_mb``, the logical size of the values."""
    from tablegauge.functions.classes import WIDTHS, dtype_class, text_form

    flat = text_form(df)
    size = F.count("*") * 0
    for f, shown in zip(df.schema, flat.schema):
        if dtype_class(f.dataType) == "categorical":
            size = size + F.coalesce(F.sum(F.octet_length(quoted(shown.name)).cast("long")), F.lit(0))
        else:
            size = size + F.count("*") * WIDTHS.get(type(f.dataType), 16)
    return flat.agg(size.alias("bytes")).select(F.round(F.col("bytes") / 1e6, 3).alias("data_mb"))


def distinct_by_column(df: DataFrame, how: str = "exact") -> DataFrame:
    """``name, unique, unique_pct``; all-null columns count 0."""
    from tablegauge.operators import distinct as D

    df = normalize_nulls(df)
    counts = D.approx_distinct_counts(df) if how == "approx" else D.distinct_counts(df)
    shape = per_column(df, df.columns, present=F.count)
    n = F.coalesce(F.col("n_distinct"), F.lit(0)).cast("long")
    joined = shape.join(F.broadcast(counts.withColumnRenamed("column_name", "name")), "name", "left")
    return joined.select("name", n.alias("unique"), R.percent(n, F.col("n_rows")).alias("unique_pct"))


def constant_columns(df: DataFrame, target: str | None = None) -> DataFrame:
    """Columns with at most one distinct value; an all-null column is constant too."""
    keep = F.lit(True) if target is None else F.col("name") != target
    return distinct_by_column(df).filter((F.col("unique") <= 1) & keep).select("name", "unique")
