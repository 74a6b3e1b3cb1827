"""Histograms, category bars and the correlation matrix; ``limit`` keeps the leading columns, None all."""

from __future__ import annotations

import math
from functools import reduce
from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablegauge.functions.nulls import normalize_nulls, quoted
from tablegauge.functions.session import local_rows
from tablegauge.operators.correlation import correlations
from tablegauge.operators.facts import TableFacts
from tablegauge.operators.profile import TableProfile, profile_table

BINS = 8
_HISTOGRAM = "col string, bin int, label string, count long"


def bin_edges(low: float, high: float, bins: int = BINS) -> list[float]:
    """Equal-width edges; a single value gets a small range around it, else the first edge is
    lowered a little so that the smallest value falls into the first right-closed bin."""
    if low == high:
        reach = 0.001 * abs(low) if low else 0.001
        low, high = low - reach, high + reach
        return [low + i * ((high - low) / bins) for i in range(bins)] + [high]
    edges = [low + i * ((high - low) / bins) for i in range(bins)] + [high]
    edges[0] -= (high - low) * 0.001
    return edges


def histogram_columns(facts: TableFacts, target: str | None = None, limit: int | None = None) -> list[str]:
    chosen = [c for c in facts.columns if c.numeric and c.name != target and not facts.id_like(c)][:limit]
    return [c.name for c in chosen if c.has_stats and math.isfinite(c.maximum - c.minimum)]


def histogram(df: DataFrame, facts: TableFacts, names: list[str]) -> DataFrame:
    """``col, bin, label, count``: eight right-closed bins per column, empty bins included.

    All bins of all columns are counters of one aggregate, so nothing is shuffled but one row.
    """
    if not names:
        return local_rows(df.sparkSession, [], _HISTOGRAM)
    df = normalize_nulls(df)
    aggs, rows = [], []
    for i, name in enumerate(names):
        c = facts[name]
        edges = bin_edges(c.minimum, c.maximum)
        x = quoted(name).cast("double")
        for b in range(BINS):
            inside = x <= edges[b + 1] if b == 0 else (x > edges[b]) & (x <= edges[b + 1])
            if b == BINS - 1:
                inside = x > edges[b]
            aggs.append(F.count_if(inside).alias(f"h{i}_{b}"))
            label = f"{edges[b]:.2g}–{edges[b + 1]:.2g}"
            rows.append(F.struct(F.lit(name).alias("col"), F.lit(b + 1).alias("bin"),
                                 F.lit(label).alias("label"), F.col(f"h{i}_{b}").alias("count")))
    return df.agg(*aggs).select(F.inline(F.array(*rows)))


def bar_columns(df: DataFrame, facts: TableFacts, target: str | None = None, limit: int | None = None) -> list[str]:
    text = {f.name for f in df.schema if isinstance(f.dataType, (T.StringType, T.CharType, T.VarcharType))}
    chosen = [c for c in facts.columns if c.name in text and c.name != target and not facts.id_like(c)]
    return [c.name for c in chosen[:limit]]


def category_bars(df: DataFrame, names: list[str], top: int = 10) -> DataFrame:
    """``col, rank, value, count``: the most frequent values per column, ties by value."""
    parts = []
    for name in names:
        counted = df.select(quoted(name).alias("value")).dropna().groupBy("value").agg(F.count("*").alias("count"))
        best = counted.orderBy(F.desc("count"), "value").limit(top)
        # At most ``top`` rows: ranking them in one task is free.
        rows = best.agg(F.sort_array(F.collect_list(F.struct((-F.col("count")).alias("neg"), "value"))).alias("best"))
        parts.append(rows.select(F.posexplode("best").alias("at", "b")).select(
            F.lit(name).alias("col"), (F.col("at") + 1).alias("rank"), F.col("b.value").alias("value"),
            (-F.col("b.neg")).alias("count")))
    if not parts:
        return local_rows(df.sparkSession, [], "col string, rank int, value string, count long")
    return reduce(DataFrame.unionByName, parts)


def matrix_columns(facts: TableFacts, target: str | None = None, limit: int | None = None) -> list[str]:
    """The target first, then the other numeric columns; without a target those that are no identifiers."""
    numeric = [c for c in facts.columns if c.numeric]
    if target in [c.name for c in numeric]:
        return [target] + [c.name for c in numeric if c.name != target][:None if limit is None else limit - 1]
    return [c.name for c in numeric if not facts.id_like(c)][:limit]


def correlation_matrix(df: DataFrame, profile: TableProfile, target: str | None = None, limit: int | None = None) -> DataFrame:
    """``row_no, col1, col2, r``: the full matrix in long form, NULL where undefined."""
    names = matrix_columns(profile.facts, target, limit)
    schema = "row_no int, col_no int, col1 string, col2 string, r double"
    if len(names) < 2:
        return local_rows(df.sparkSession, [], schema)
    found = correlations(normalize_nulls(df), list(combinations(names, 2)))
    rows = []
    for i, a in enumerate(names):
        for j, b in enumerate(names):
            c = profile.facts[a]
            varies = c.has_stats and bool(c.std_pop)
            r = (1.0 if varies else None) if i == j else found[(a, b) if i < j else (b, a)]
            rows.append((i, j, a, b, r))
    return local_rows(df.sparkSession, rows, schema).withColumn("r", F.round("r", 3))


def distributions(df: DataFrame, target: str | None = None, numeric: int | None = None, text: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Histograms and category bars of a table's columns, or of so many leading ones."""
    profile = profile_table(df, target, quartiles=False, duplicates=False)
    facts = profile.facts
    return (
        histogram(df, facts, histogram_columns(facts, target, numeric)),
        category_bars(df, bar_columns(df, facts, target, text)),
    )
