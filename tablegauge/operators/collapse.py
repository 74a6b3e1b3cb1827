"""Equal numbers and equal digests become one row each in sorted runs, before they are shuffled.

Spark's aggregate before a shuffle keeps a map of all values a task meets. Where nearly all differ, as with keys and
measured values, the map takes more memory than the task has, is spilled and sorted, and has saved nothing. A run here has at
most ``RUN_VALUES`` values. What is repeated in it, however often, leaves the task once; the rest is grouped after the shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Values that a task holds before they are sorted, in all columns together.
RUN_VALUES = 1 << 22
# Values to a partition of the shuffle, where their number is known.
PART_VALUES = 1 << 21
# Rows that a task hands on at a time.
_BATCH_ROWS = 1 << 17
_PAIRS = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("n", pa.int64())])
_DDL = "a bigint, b bigint, n bigint"


def _bits(column: pa.Array) -> np.ndarray:
    """The non-null values as 64-bit integers, equal where Spark groups them together: all NaN, and both zeros."""
    x = column.drop_null().to_numpy(zero_copy_only=False)
    if x.dtype != np.float64:
        return x.astype(np.int64, copy=False)
    x = x + 0.0
    x[np.isnan(x)] = np.nan
    return x.view(np.int64)


def _rows(a: np.ndarray, b: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
    for at in range(0, len(a), _BATCH_ROWS):
        yield pa.RecordBatch.from_arrays([pa.array(x[at:at + _BATCH_ROWS]) for x in (a, b, n)], schema=_PAIRS)


def _shuffled(pairs: DataFrame, values: int | None) -> DataFrame:
    """Equal pairs in one partition; with a known number of values, these in partitions of ``PART_VALUES``."""
    if values is None:
        return pairs.repartition("a", "b")
    return pairs.repartition(max(1, -(-values // PART_VALUES)), "a", "b")


def distinct_numbers(cells: DataFrame, values: int | None = None) -> DataFrame:
    """``(a, n_distinct)``: the place of each column of BIGINT or DOUBLE and its number of non-null values, none of 0.

    ``values`` is how many values all columns hold, if that is known.
    """
    width = len(cells.columns)
    most = max(1, RUN_VALUES // width)

    def collapsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = [[] for _ in range(width)]
        sizes = [0] * width

        def sent(i: int) -> Iterator[pa.RecordBatch]:
            x = held[i][0]
            yield from _rows(np.full(len(x), i), x, np.ones(len(x), dtype=np.int64))
            held[i], sizes[i] = [], 0

        for batch in batches:
            for i, column in enumerate(batch.columns):
                held[i].append(_bits(column))
                sizes[i] += len(held[i][-1])
                if sizes[i] >= most:
                    held[i] = [np.unique(np.concatenate(held[i]))]
                    sizes[i] = len(held[i][0])
                    if 2 * sizes[i] > most:  # few values stay, to meet those that follow
                        yield from sent(i)
        for i in range(width):
            if held[i]:
                held[i] = [np.unique(np.concatenate(held[i]))]
                yield from sent(i)

    pairs = _shuffled(cells.mapInArrow(collapsed, _DDL), values).select("a", "b")
    return pairs.distinct().groupBy("a").agg(F.count("*").alias("n_distinct"))


def _summed(a: np.ndarray, b: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Equal pairs once, with the sum of their numbers."""
    order = np.lexsort((b, a))
    a, b, n = a[order], b[order], n[order]
    first = np.flatnonzero(np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])))
    return a[first], b[first], np.add.reduceat(n, first)


def pair_copies(pairs: DataFrame) -> DataFrame:
    """``(a, b, copies)``: the different pairs of two BIGINT columns without nulls, and how often each occurs."""
    most = RUN_VALUES // 4

    def collapsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        size = 0
        for batch in batches:
            if batch.num_rows:
                held.append((*[c.to_numpy() for c in batch.columns], np.ones(batch.num_rows, dtype=np.int64)))
                size += batch.num_rows
            if size >= most:
                held = [_summed(*map(np.concatenate, zip(*held)))]
                size = len(held[0][0])
                if 2 * size > most:
                    yield from _rows(*held[0])
                    held, size = [], 0
        if held:
            yield from _rows(*_summed(*map(np.concatenate, zip(*held))))

    return _shuffled(pairs.mapInArrow(collapsed, _DDL), None).groupBy("a", "b").agg(F.sum("n").alias("copies"))
