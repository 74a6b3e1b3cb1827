"""Exact positions in sorted order for very many groups at once, fully spread.

Rows are range-partitioned by (group, value), so a hot group is cut into as many pieces as its
size asks for. A piece knows its own counts; the pieces of a group, a few numbers each, are
summed in order to give every piece its starting position.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablegauge.functions.joins import joined_by_key
from tablegauge.functions.nulls import quoted
from tablegauge.functions.session import written


def positions(freq: DataFrame, keys: list[str], value: str, count: str) -> DataFrame:
    """Adds ``first`` and ``last``: the 0-based positions the value takes in its group's order.

    ``freq`` holds one row per (keys, value) with its count. The cut into pieces is drawn by
    sampling, so it is written before it is used twice.
    """
    order = [*map(quoted, keys), quoted(value)]
    cut = written(freq.repartitionByRange(*order).withColumn("__piece", F.spark_partition_id()), "ranks")
    sizes = cut.groupBy(*keys, "__piece").agg(F.sum(count).alias("__size"))
    before = Window.partitionBy(*keys).orderBy("__piece").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(*keys, "__piece", F.coalesce(F.sum("__size").over(before), F.lit(0)).alias("__start"))
    within = Window.partitionBy(*keys, "__piece").orderBy(quoted(value)).rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    upto = F.sum(count).over(within)
    ranked = cut.withColumn("__upto", upto).join(starts, [*keys, "__piece"])
    return ranked.select(
        *keys, value, count,
        (F.col("__start") + F.col("__upto") - F.col(count)).alias("first"),
        (F.col("__start") + F.col("__upto") - 1).alias("last"),
    )


def ordered_codes(df: DataFrame, col: str) -> DataFrame:
    """``value, code``: the distinct non-null values of a column numbered in sorted order from 0."""
    values = df.select(quoted(col).alias("value")).dropna().distinct().withColumn("one", F.lit(1).cast("long"))
    ranked = positions(values.withColumn("all", F.lit(0)), ["all"], "value", "one")
    return ranked.select("value", F.col("first").alias("code"))


def grouped_quantiles(rows: DataFrame, keys: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """Linearly interpolated quantiles of ``value`` per group: keys, ``n``, one column per share."""
    # Read for the positions and for the totals, and again where their size is measured.
    freq = written(rows.select(*keys, value).dropna().groupBy(*keys, value).agg(F.count("*").alias("__freq")), "counts")
    ranked = positions(freq, keys, value, "__freq")
    totals = freq.groupBy(*keys).agg(F.sum("__freq").alias("n"))
    placed = joined_by_key(ranked, totals, keys)
    aggs: list[Column] = [F.first("n").alias("n")]
    for name, p in shares.items():
        place = (F.col("n") - 1) * F.lit(p)
        low, high = F.floor(place), F.ceil(place)
        v = quoted(value)
        at_low = F.max(F.when((F.col("first") <= low) & (low <= F.col("last")), v))
        at_high = F.max(F.when((F.col("first") <= high) & (high <= F.col("last")), v))
        part = F.first((F.col("n") - 1) * F.lit(p)) - F.floor(F.first((F.col("n") - 1) * F.lit(p)))
        aggs.append((at_low + (at_high - at_low) * part).alias(name))
    return placed.groupBy(*keys).agg(*aggs)
