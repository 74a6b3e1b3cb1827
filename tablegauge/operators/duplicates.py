"""Rows that equal an earlier row, without shuffling whole rows.

Counting groups a 128-bit digest per row, so some 30 bytes travel per distinct row whatever its
width, and equal rows collapse before the shuffle, however hot they are (without keys by ``collapse``, which does not spill where
nearly all rows differ). Listing the
repeated rows themselves compares full contents: a 64-bit hash finds the candidates, and only
they are grouped by all their cells.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablegauge.functions.classes import text_form
from tablegauge.functions.nulls import normalize_nulls, quoted
from tablegauge.operators.collapse import pair_copies


def row_digest(df: DataFrame) -> list[Column]:
    """Two independent 64-bit hashes of a row, to be used on text forms with normalised nulls.

    The hash of a row passes over nulls, so ``(null, 1)`` and ``(1, null)`` share the first one;
    the second also takes in which cells are null, and reads the cells from the other end.
    """
    cells = [quoted(c) for c in df.columns]
    gaps = [c.isNull() for c in cells]
    return [F.xxhash64(*cells).alias("__h1"), F.xxhash64(F.lit(1), *gaps, *cells[::-1]).alias("__h2")]


def duplicate_count(df: DataFrame, keys: list[str] = ()) -> DataFrame:
    """``(duplicate_rows)``: rows beyond the first of each group of equal rows; null equals null.

    With ``keys``, one row per combination of those columns.
    """
    flat = normalize_nulls(text_form(df))
    digests = flat.select(*[quoted(k) for k in keys], *row_digest(flat))
    if keys:
        copies = digests.groupBy(*keys, "__h1", "__h2").agg(F.count("*").alias("copies"))
    else:
        copies = pair_copies(digests)
    extra = F.coalesce(F.sum(F.col("copies") - 1), F.lit(0)).cast("long")
    return copies.groupBy(*keys).agg(extra.alias("duplicate_rows"))


def duplicate_groups(df: DataFrame) -> DataFrame:
    """The distinct rows that occur more than once, with ``copies``."""
    flat = normalize_nulls(text_form(df))
    cells = [quoted(c) for c in flat.columns]
    hashed = flat.select("*", F.xxhash64(*cells).alias("__row_hash"))
    repeated = (
        hashed.groupBy("__row_hash").agg(F.count("*").alias("__n"))
        .filter(F.col("__n") > 1).select("__row_hash")
    )
    rows = hashed.join(repeated, "__row_hash", "left_semi")
    return rows.groupBy(*cells).agg(F.count("*").alias("copies")).filter(F.col("copies") > 1)


def duplicate_rows(df: DataFrame) -> DataFrame:
    """One row: ``rows, duplicate_rows, duplicate_pct``."""
    total = df.agg(F.count("*").alias("rows"))
    pct = F.coalesce(F.round(F.try_divide("duplicate_rows", "rows") * 100, 2), F.lit(0.0))
    # Two one-row results side by side.
    return total.crossJoin(F.broadcast(duplicate_count(df))).withColumn("duplicate_pct", pct)


def clean_rows(df: DataFrame) -> DataFrame:
    """One row: rows before and after removing duplicates."""
    return duplicate_rows(df).select(
        "rows", "duplicate_rows", (F.col("rows") - F.col("duplicate_rows")).alias("clean_rows")
    )
