"""Audit of a name column against an identifier column that mixes two formats."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablegauge.functions import keywords as K
from tablegauge.functions.joins import joined_by_key
from tablegauge.functions.nulls import number, quoted
from tablegauge.functions.session import checkpointed, local_rows
from tablegauge.operators.facts import outside
from tablegauge.operators.quantiles import quantiles

# Fixed value: identifiers below it are of the short format.
SHORT_LIMIT = 10_000


def id_format_case(ident: Column, limit: int = SHORT_LIMIT) -> Column:
    """``short`` or ``long``; a missing identifier counts as long."""
    return F.when(ident < limit, "short").otherwise("long")


def split_by_threshold(df: DataFrame, ident: str, limit: int = SHORT_LIMIT) -> tuple[DataFrame, DataFrame]:
    """Rows below the limit, and rows at or above it; rows without identifier are in neither."""
    return df.filter(quoted(ident) < limit), df.filter(quoted(ident) >= limit)


def basic_distinct_stats(df: DataFrame, name: str, ident: str) -> DataFrame:
    """One row: rows, distinct names, distinct identifiers."""
    return df.agg(F.count("*").alias("rows"), F.count_distinct(quoted(name)).alias("distinct_names"),
                  F.count_distinct(quoted(ident)).alias("distinct_ids"))


def format_split_ranges(df: DataFrame, ident: str) -> DataFrame:
    """Rows, smallest and largest identifier per format."""
    rows = df.select(quoted(ident).alias("id")).dropna()
    return rows.groupBy(id_format_case(F.col("id")).alias("id_format")).agg(
        F.count("*").alias("rows"), F.min("id").alias("min_id"), F.max("id").alias("max_id"))


class Fences:
    """Quartiles and fences of one numeric column, exact."""

    def __init__(self, df: DataFrame, col: str):
        x = number(col)
        n = df.agg(F.count(x)).first()[0]
        self.q1, self.q3 = quantiles(df, {col: x}, [0.25, 0.75], {col: n})[col]
        self.iqr = None if self.q1 is None else self.q3 - self.q1
        self.lower = None if self.q1 is None else self.q1 - K.FENCE_FACTOR * self.iqr
        self.upper = None if self.q1 is None else self.q3 + K.FENCE_FACTOR * self.iqr
        self.flag = F.lit(False) if self.q1 is None else outside(x, self.lower, self.upper)


def iqr_fences(df: DataFrame, ident: str) -> DataFrame:
    """One row: quartiles, fences, flagged rows, and how many of them are of the short format."""
    f = Fences(df, ident)
    short = quoted(ident) < SHORT_LIMIT
    stats = [F.lit(v).cast("double").alias(k)
             for k, v in (("q1", f.q1), ("q3", f.q3), ("iqr", f.iqr), ("lower_fence", f.lower), ("upper_fence", f.upper))]
    return df.agg(F.count_if(f.flag).alias("flagged"), F.count_if(f.flag & short).alias("flagged_short")).select(
        *stats, "flagged", "flagged_short")


def outlier_rows(df: DataFrame, ident: str, show: list[str], limit: int = 10) -> DataFrame:
    """The first rows outside the fences, in the order of the shown columns."""
    f = Fences(df, ident)
    return df.filter(f.flag).select([quoted(c) for c in show]).orderBy(*show[::-1]).limit(limit)


def normalize_text(c: Column) -> Column:
    return F.lower(F.trim(c))


def normalization_gain(df: DataFrame, name: str) -> DataFrame:
    """One row: distinct spellings before and after normalising, and the difference."""
    pairs = df.select(quoted(name).alias("raw")).dropna().distinct().select("raw", normalize_text(F.col("raw")).alias("norm"))
    norm = pairs.groupBy("norm").agg(F.count("*").alias("n"))
    return norm.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("raw_distinct"), F.count("*").alias("normalized_distinct")).select(
        "raw_distinct", "normalized_distinct",
        (F.col("raw_distinct") - F.col("normalized_distinct")).alias("fixed_by_normalization"))


def text_variants(df: DataFrame, name: str) -> DataFrame:
    """``name_norm, spelling, variants``: one row per spelling of each name written in several ways.

    Rows instead of one list per name, so that a name with very many spellings stays spread.
    """
    pairs = df.select(quoted(name).alias("spelling")).dropna().distinct().withColumn(
        "name_norm", normalize_text(F.col("spelling")))
    several = pairs.groupBy("name_norm").agg(F.count("*").alias("variants")).filter("variants > 1")
    return joined_by_key(pairs, several, ["name_norm"]).select("name_norm", "spelling", "variants")


def _violations(df: DataFrame, key: Column, value: Column, shown: dict[str, Column]) -> DataFrame:
    """Combinations of rows whose key goes with more than one value, with their row counts.

    Equal rows are counted together before anything is shuffled by key.
    """
    cells = {"__key": key, "__value": value, **shown}
    rows = df.select([c.alias(k) for k, c in cells.items()]).dropna(subset=["__key", "__value"])
    combos = rows.groupBy(*cells).agg(F.count("*").alias("rows"))
    several = (
        combos.select("__key", "__value").distinct()
        .groupBy("__key").agg(F.count("*").alias("n_values")).filter("n_values > 1")
    )
    return joined_by_key(combos, several, ["__key"])


def fd_violation_id_to_name(df: DataFrame, name: str, ident: str) -> DataFrame:
    """Identifiers that go with several normalised names: the names as written, with row counts."""
    found = _violations(df, quoted(ident), normalize_text(quoted(name)), {"name": quoted(name)})
    return found.select(F.col("__key").alias("id"), "name", "rows", F.col("n_values").alias("n_names"))


def fd_violation_name_to_id(df: DataFrame, name: str, ident: str) -> DataFrame:
    """Normalised names that go with several identifiers: the identifiers, with row counts."""
    found = _violations(df, normalize_text(quoted(name)), quoted(ident), {})
    return found.select(F.col("__key").alias("name_norm"), F.col("__value").alias("id"), "rows",
                        F.col("n_values").alias("n_ids"))


def trim_clean(df: DataFrame, name: str) -> DataFrame:
    """Outer blanks removed, case kept."""
    return df.withColumn(name, F.trim(quoted(name)))


def dedupe_subset(df: DataFrame, subset: list[str]) -> DataFrame:
    """One row per combination of the subset's values."""
    return df.dropDuplicates(subset)


def clean_table(df: DataFrame, name: str, ident: str) -> DataFrame:
    """Trimmed names, identifier format, one row per (name, identifier)."""
    rows = trim_clean(df, name).withColumn("id_format", id_format_case(quoted(ident)))
    return dedupe_subset(rows, [name, ident])


def grouped_iqr_outliers(df: DataFrame, ident: str) -> DataFrame:
    """Fences and outliers per identifier format; groups below four rows or without spread give none."""
    x = number(ident)
    form = id_format_case(quoted(ident))
    parts = {k: F.when(form == k, x) for k in ("short", "long")}
    sizes = df.agg(*[F.count(e).alias(k) for k, e in parts.items()]).first().asDict()
    found = quantiles(df, parts, [0.25, 0.75], sizes)
    flags = []
    for k, e in parts.items():
        q1, q3 = found[k]
        spread = sizes[k] >= 4 and q3 > q1
        reach = K.FENCE_FACTOR * (q3 - q1) if spread else 0.0
        flags.append(F.count_if(outside(e, q1 - reach, q3 + reach) if spread else F.lit(False)).alias(k))
    hits = df.agg(*flags).first().asDict()
    rows = [(k, sizes[k], *found[k], hits[k]) for k in parts if sizes[k]]
    return local_rows(df.sparkSession, rows, "id_format string, rows long, q1 double, q3 double, outliers long")


def audit_summary(df: DataFrame, name: str, ident: str) -> DataFrame:
    """One row: outliers before and after the split by format, and the consistency counts."""
    before = iqr_fences(df, ident).select(F.col("flagged").alias("outliers_before"))
    # One row per spelling and identifier as written, fixed once: all but the first and the third figure need no more.
    pairs = checkpointed(df.select(quoted(name).alias(name), quoted(ident).alias(ident)).distinct())
    cleaned = grouped_iqr_outliers(checkpointed(clean_table(pairs, name, ident)), ident)
    after = cleaned.agg(F.coalesce(F.sum("outliers"), F.lit(0)).alias("outliers_after"))
    short = df.agg(F.count_if(quoted(ident) < SHORT_LIMIT).alias("short_ids"))
    gain = normalization_gain(pairs, name).select("fixed_by_normalization")
    ids = fd_violation_id_to_name(pairs, name, ident).agg(F.count_distinct("id").alias("ids_with_several_names"))
    names = fd_violation_name_to_id(pairs, name, ident).agg(F.count_distinct("name_norm").alias("names_with_several_ids"))
    row = before
    for part in (after, short, gain, ids, names):
        row = row.crossJoin(F.broadcast(part))  # one row each
    return row.withColumn("reduction", F.col("outliers_before") - F.col("outliers_after"))
