"""Joins with a table that has one row per key, safe for hot keys whatever the optimizer does."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablegauge.functions.nulls import quoted

#: A lookup table of at most so many bytes of text is broadcast.
BROADCAST_BYTES = 32 << 20
#: A key with more than this share of the rows is hot; there are fewer than ``1 / HOT_SHARE`` such keys.
HOT_SHARE = 1 / 200


def joined_by_key(rows: DataFrame, found: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """``rows`` with the columns of ``found``, which has one row per combination of the keys; nulls match nothing.

    A small ``found`` is broadcast, after its size is measured. Otherwise only the hot keys are, of which there
    can be few, and the others are joined by a shuffle in which no key has many rows.
    """
    size = found.agg(F.coalesce(F.sum(F.octet_length(F.to_json(F.struct("*")))), F.lit(0))).first()[0]
    if size <= BROADCAST_BYTES:
        return rows.join(F.broadcast(found), keys, how)
    counts = rows.groupBy(*map(quoted, keys)).agg(F.count("*").alias("__n"))
    total = rows.count()
    hot = counts.where(F.col("__n") > total * HOT_SHARE).drop("__n")
    named = hot.select(*[quoted(k).alias(f"__key{i}") for i, k in enumerate(keys)], F.lit(True).alias("__hot"))
    same = reduce(lambda a, b: a & b, [quoted(k).eqNullSafe(F.col(f"__key{i}")) for i, k in enumerate(keys)])
    marked = rows.join(F.broadcast(named), same, "left").drop(*[f"__key{i}" for i in range(len(keys))])
    often = marked.where("__hot").drop("__hot")
    seldom = marked.where("__hot is null").drop("__hot")
    few = found.join(F.broadcast(hot), keys, "left_semi")
    return often.join(F.broadcast(few), keys, how).unionByName(seldom.join(found.hint("shuffle_merge"), keys, how))
