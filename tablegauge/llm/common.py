"""Helpers of the text operators: reading, staging, and lookups on keys that may be hot."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablegauge.functions.session import fresh_path

#: A key with more than this share of the rows is hot; there are fewer than ``1 / HOT_SHARE`` such keys.
HOT_SHARE = 1 / 200


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table, whole."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def staged(df: DataFrame, name: str) -> DataFrame:
    """The same rows, written once to the shared folder and read from there.

    Later reads see exactly these rows, and a lost executor costs a read instead of a recomputation.
    """
    path = fresh_path(df.sparkSession, name)
    df.write.option("compression", "zstd").option("parquet.block.size", 32 << 20).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def joined_by_key(rows: DataFrame, found: DataFrame, key: str, n: str, total: int, how: str = "inner") -> DataFrame:
    """``rows`` with the columns of ``found``, which has one row per ``key`` and in ``n`` its count of rows.

    Keys that hold more than ``HOT_SHARE`` of all rows are fewer than ``1 / HOT_SHARE``: only these are
    broadcast, so that no task gets all rows of one key. The others are joined by a shuffle, however small Spark
    takes them for: files of equal or ordered numbers hold far more rows than their size tells.
    """
    hot = F.col(n) > F.lit(total * HOT_SHARE)
    few = F.broadcast(found.where(hot).drop(n))
    names = found.where(hot).select(F.col(key).alias("_hot_key"))
    apart = rows.join(F.broadcast(names), rows[key] == F.col("_hot_key"), "left")
    often = apart.where(F.col("_hot_key").isNotNull()).drop("_hot_key").join(few, key)
    seldom = apart.where(F.col("_hot_key").isNull()).drop("_hot_key").join(found.where(~hot).drop(n).hint("merge"), key, how)
    return often.select(seldom.columns).unionByName(seldom)


def text_groups(batches: Iterator[pa.RecordBatch], column: str, limit: int) -> Iterator[pa.RecordBatch]:
    """The batches cut into runs of rows whose texts have at most ``limit`` bytes, or a single row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        texts = batch.column(batch.schema.get_field_index(column))
        sizes = np.asarray(pa.compute.fill_null(pa.compute.binary_length(texts), 0), dtype=np.int64)
        ends = np.cumsum(sizes)
        first = 0
        while first < len(sizes):
            before = ends[first - 1] if first else 0
            last = max(first + 1, int(np.searchsorted(ends, before + limit, side="right")))
            yield batch.slice(first, last - first)
            first = last


def arrow_table(columns: dict, schema: pa.Schema) -> pa.RecordBatch:
    """A record batch of the columns, in the order and types of the schema."""
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], type=f.type) for f in schema], schema=schema)
