"""Pearson correlation of column pairs over all rows, pairwise complete, in one scan."""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema

from tablegauge.functions.classes import columns_of
from tablegauge.functions.nulls import quoted
from tablegauge.functions.session import checkpointed, local_rows


def varies(x: Column) -> Column:
    """Whether a group's values differ. Merged moments of a constant need not be exactly zero."""
    return F.min(x) != F.max(x)


# Bytes of partial results that one task merges; at least two of them.
_MERGE_BYTES = 256 << 20
_FAN = 64
_PARTIAL = pa.schema([("at", pa.int64()), ("parts", pa.binary())])
# Matrices of a partial result, by (column, other column) over the rows that have both: rows, and of the column
# the mean, the squares around it, smallest and largest value; last the products of both around their means.
_N, _MEAN, _SQUARES, _LOW, _HIGH, _PRODUCTS = range(6)
# Rows of a combination of keys up to which its matrices are made together with those of others.
_FEW_ROWS = 256
# Bytes of products that are at hand at a time while matrices are made together, and of rows that wait for it.
_BLOCK_BYTES = 4 << 20
_WAIT_BYTES = 32 << 20


def _block(x: np.ndarray) -> np.ndarray:
    """The matrices of some rows; NaN is a missing value."""
    there = ~np.isnan(x)
    mask = there.astype(float)
    n = mask.T @ mask
    with np.errstate(all="ignore"):
        centre = np.where(mask.sum(axis=0) > 0, np.where(there, x, 0).sum(axis=0) / np.maximum(mask.sum(axis=0), 1), 0)
        z = np.where(there, x - centre, 0)
        sums = z.T @ mask
        mean = sums / np.maximum(n, 1)
        squares = np.maximum((z * z).T @ mask - sums * mean, 0)
        products = z.T @ z - sums * mean.T
    out = np.stack([n, mean + centre[:, None], squares, np.full_like(n, np.inf), np.full_like(n, -np.inf), products])
    whole = there.all(axis=0)
    for j in range(x.shape[1]):
        if j and whole[j] and whole[:j].any():  # as of another column without gaps
            first = int(np.argmax(whole[:j]))
            out[_LOW, :, j], out[_HIGH, :, j] = out[_LOW, :, first], out[_HIGH, :, first]
        elif there[:, j].any():
            rows = x if whole[j] else x[there[:, j]]
            out[_LOW, :, j] = np.fmin.reduce(rows, axis=0, initial=np.inf)
            out[_HIGH, :, j] = np.fmax.reduce(rows, axis=0, initial=-np.inf)
    return out


def _blocks(x: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The matrices, (6, groups, columns, columns), of groups of rows that begin at ``starts``; NaN is a missing value."""
    sizes = np.diff(np.append(starts, len(x)))
    there = ~np.isnan(x)
    mask, full = there.astype(float), np.where(there, x, 0)
    known = np.add.reduceat(mask, starts)
    with np.errstate(all="ignore"):
        centre = np.add.reduceat(full, starts) / np.maximum(known, 1)
        z = np.where(there, x - np.repeat(centre, sizes, axis=0), 0)
        both = there[:, :, None] & there[:, None, :]
        n = np.add.reduceat(both.astype(float), starts)
        sums = np.add.reduceat(z[:, :, None] * mask[:, None, :], starts)
        mean = sums / np.maximum(n, 1)
        squares = np.maximum(np.add.reduceat((z * z)[:, :, None] * mask[:, None, :], starts) - sums * mean, 0)
        products = np.add.reduceat(z[:, :, None] * z[:, None, :], starts) - sums * mean.transpose(0, 2, 1)
    low = np.minimum.reduceat(np.where(both, x[:, :, None], np.inf), starts)
    high = np.maximum.reduceat(np.where(both, x[:, :, None], -np.inf), starts)
    return np.stack([n, mean + centre[:, :, None], squares, low, high, products])


def _grouped(x: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The matrices, (6, groups, columns, columns), of groups of rows: the few rows of many groups together, a large one by itself."""
    width, ends = x.shape[1], np.append(starts[1:], len(x))
    out = np.empty((6, len(starts), width, width))
    few = ends - starts <= _FEW_ROWS
    for g in np.flatnonzero(~few).tolist():
        out[:, g] = _block(x[starts[g]:ends[g]])
    most = max(1, _BLOCK_BYTES // (8 * width * width))
    some, place = np.flatnonzero(few), np.cumsum((ends - starts)[few])
    for at in np.split(some, np.flatnonzero(np.diff(place // most)) + 1) if len(some) else []:
        sizes = (ends - starts)[at]
        first = np.cumsum(sizes) - sizes
        rows = np.repeat(starts[at] - first, sizes) + np.arange(int(sizes.sum()))
        out[:, at] = _blocks(x[rows], first)
    return out


def _merged(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The matrices of the rows of both parts, or of each two parts of the same group."""
    n = a[_N] + b[_N]
    with np.errstate(all="ignore"):
        share = b[_N] / np.maximum(n, 1)
        away = b[_MEAN] - a[_MEAN]
        weight = a[_N] * share
        mean = np.where(a[_N] == 0, b[_MEAN], np.where(b[_N] == 0, a[_MEAN], a[_MEAN] + away * share))
        away = np.where(weight > 0, away, 0)
        return np.stack([
            n, mean, a[_SQUARES] + b[_SQUARES] + away * away * weight, np.minimum(a[_LOW], b[_LOW]), np.maximum(a[_HIGH], b[_HIGH]),
            a[_PRODUCTS] + b[_PRODUCTS] + away * away.swapaxes(-1, -2) * weight])


def _moments(df: DataFrame, names: list[str]) -> np.ndarray | None:
    """The matrices of all rows: one scan, whatever the number of columns, and partial results merged in a tree."""
    width = len(names)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                own = _block(np.column_stack([c.to_numpy(zero_copy_only=False).astype(float) for c in batch.columns]))
                total = own if total is None else _merged(total, own)
        if total is not None:
            yield pa.RecordBatch.from_pydict({"at": [TaskContext.get().partitionId()], "parts": [total.tobytes()]}, schema=_PARTIAL)

    def opened(blob: bytes) -> np.ndarray:
        return np.frombuffer(blob, dtype=float).reshape(6, width, width)

    def merge(key: tuple, group: pa.Table) -> pa.Table:
        parts = [opened(b) for b in group.sort_by("at").column("parts").to_pylist()]
        return pa.Table.from_pydict({"at": [key[0].as_py()], "parts": [reduce(_merged, parts).tobytes()]}, schema=_PARTIAL)

    cells = df.select(*[quoted(c).cast("double").alias(str(i)) for i, c in enumerate(names)])
    schema = from_arrow_schema(_PARTIAL)
    parts = cells.mapInArrow(partial, schema)
    fan = max(2, min(_FAN, _MERGE_BYTES // (6 * 8 * width * width)))
    parts = checkpointed(parts)
    left = (parts.agg(F.max("at")).first()[0] or 0) + 1
    while left > 1:
        parts = parts.select(F.floor(F.col("at") / fan).cast("bigint").alias("to"), "at", "parts").groupBy("to").applyInArrow(merge, schema)
        left = -(-left // fan)
    rows = parts.collect()  # one, or none for an empty table
    return opened(bytes(rows[0]["parts"])) if rows else None


def _r(m: np.ndarray) -> np.ndarray:
    """r of each two columns from their matrices; NaN where it is undefined."""
    with np.errstate(all="ignore"):
        r = m[_PRODUCTS] / np.sqrt(m[_SQUARES] * m[_SQUARES].T)
    known = np.isfinite(r) & (m[_LOW] < m[_HIGH]) & (m[_LOW] < m[_HIGH]).T
    return np.where(known, np.clip(r, -1.0, 1.0), np.nan)


def mean_abs_correlation_by(df: DataFrame, keys: list[str], names: list[str], fan: int = _FAN) -> DataFrame:
    """The keys and ``correlation``: the mean |r| over all pairs of columns with a defined r; NULL without any.

    A task keeps matrices for each combination of the keys that it meets, and hands them on when they take
    ``_MERGE_BYTES`` together; no row is multiplied by pairs. The parts of a combination are merged ``fan`` at a time by
    the tasks that sent them, so one dataset may hold most of the rows.
    """
    width, k = len(names), len(keys)
    size = 6 * 8 * width * width
    fan = max(2, min(fan, _MERGE_BYTES // size))
    cells = df.select(*[quoted(c).alias(f"k{i}") for i, c in enumerate(keys)], *[quoted(c).cast("double").alias(str(i)) for i, c in enumerate(names)])
    key_fields = [f"`k{i}` {cells.schema[i].dataType.simpleString()}" for i in range(k)]
    schema = ", ".join([*key_fields, "at bigint", "parts binary"])

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, places, owns = TaskContext.get().partitionId(), {}, []  # the place of a combination in ``held``, and its keys
        held = np.empty((6, 0, width, width))

        def sent() -> Iterator[pa.RecordBatch]:
            own = [pa.concat_arrays(arrays) for arrays in zip(*owns)]
            step = max(1, _BLOCK_BYTES // size)
            for at in range(0, len(places), step):
                n = min(step, len(places) - at)
                parts = pa.array([held[:, i].tobytes() for i in range(at, at + n)], pa.binary())
                yield pa.RecordBatch.from_arrays([*[c.slice(at, n) for c in own], pa.array([node] * n, pa.int64()), parts], names=[*[f"k{i}" for i in range(k)], "at", "parts"])

        def added(waiting: list[pa.RecordBatch]) -> np.ndarray:
            table = pa.Table.from_batches(waiting).combine_chunks()
            cells = [c.chunk(0) for c in table.columns[:k]]
            codes = np.column_stack([c.dictionary_encode(null_encoding="encode").indices.to_numpy() for c in cells])
            _, first, which = np.unique(codes, axis=0, return_index=True, return_inverse=True)
            which = which.reshape(-1)
            order = np.argsort(which, kind="stable")
            x = np.column_stack([c.to_numpy().astype(float) for c in table.columns[k:]])[order]
            found = _grouped(x, np.searchsorted(which[order], np.arange(len(first))))
            named = [c.take(pa.array(first)) for c in cells]
            before = len(places)
            to = np.array([places.setdefault(key, len(places)) for key in map(repr, zip(*[c.to_pylist() for c in named]))])
            old, new = np.flatnonzero(to < before), np.flatnonzero(to >= before)
            held[:, to[old]] = _merged(held[:, to[old]], found[:, old])
            owns.append([c.take(pa.array(new)) for c in named])
            return np.concatenate([held, found[:, new]], axis=1)

        waiting: list[pa.RecordBatch] = []
        for batch in itertools.chain(batches, [None]):
            if batch is not None and batch.num_rows:
                waiting.append(batch)
            if waiting and (batch is None or sum(b.nbytes for b in waiting) > _WAIT_BYTES):
                held, waiting = added(waiting), []
            if places and (batch is None or held.nbytes > _MERGE_BYTES):
                yield from sent()
                places.clear()
                owns.clear()
                held = held[:, :0]

    def merge(key: tuple, group: pa.Table) -> pa.Table:
        group = group.sort_by("at")
        total = reduce(_merged, (np.frombuffer(b.as_py(), dtype=float).reshape(6, width, width) for b in group.column("parts")))
        one = group.slice(0, 1).select([*[f"k{i}" for i in range(k)], "at", "parts"])
        one = one.set_column(k, "at", pa.array([key[-1].as_py()], pa.int64()))
        return one.set_column(k + 1, "parts", pa.array([total.tobytes()], pa.binary()))

    def mean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        upper = np.triu_indices(width, 1)
        for batch in batches:
            found = [np.abs(_r(np.frombuffer(b.as_py(), dtype=float).reshape(6, width, width))[upper]) for b in batch.column("parts")]
            means = [float(np.nanmean(r)) if np.isfinite(r).any() else None for r in found]
            yield pa.RecordBatch.from_arrays([*batch.columns[:k], pa.array(means, pa.float64())], names=[*[f"k{i}" for i in range(k)], "r"])

    parts = checkpointed(cells.mapInArrow(partial, schema))
    left = (parts.agg(F.max("at")).first()[0] or 0) + 1
    while True:  # once at least: a task may send several parts of a combination
        parts = parts.select(*[f"k{i}" for i in range(k)], "at", "parts", F.floor(F.col("at") / fan).cast("bigint").alias("to")).groupBy(
            *[f"k{i}" for i in range(k)], "to").applyInArrow(merge, schema)
        left = -(-left // fan)
        if left <= 1:
            break
    found = parts.mapInArrow(mean, ", ".join([*key_fields, "r double"]))
    return found.select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(keys)], F.col("r").alias("correlation"))


def correlations(df: DataFrame, pairs: list[tuple[str, str]]) -> dict[tuple[str, str], float | None]:
    """r of each pair, over the rows in which both sides are present (no NaN, see ``normalize_nulls``)."""
    names = list(dict.fromkeys(c for pair in pairs for c in pair))
    m = _moments(df, names) if names else None
    if m is None:
        return dict.fromkeys(pairs)
    at = {c: i for i, c in enumerate(names)}
    r = _r(m)
    return {(a, b): None if np.isnan(r[at[a], at[b]]) else float(r[at[a], at[b]]) for a, b in pairs}


def pair_table(df: DataFrame, names: list[str]) -> DataFrame:
    """``(col1, col2, position, r)`` of all unordered pairs with a defined r, unrounded."""
    found = correlations(df, list(combinations(names, 2)))
    rows = [(a, b, k, r) for k, ((a, b), r) in enumerate(found.items()) if r is not None]
    return local_rows(df.sparkSession, rows, "col1 string, col2 string, position int, r double")


def numeric_columns(df: DataFrame) -> list[str]:
    return columns_of(df, "numeric")
