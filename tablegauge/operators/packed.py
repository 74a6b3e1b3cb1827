"""Meta-features of the datasets in a table that have few rows each: every row travels once, packed.

A task sorts the rows it meets by bucket, a hash of the keys, and sends the rows of a bucket as one compressed block, a column
after the other. A bucket holds whole datasets, and all their numbers are made from its rows by the same numpy calls. Datasets with
more than ``FEW_ROWS`` rows are for ``meta_features_by`` itself.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablegauge.functions import keywords as K
from tablegauge.functions.classes import text_form
from tablegauge.functions.nulls import quoted
from tablegauge.operators import correlation as R

# Rows of a dataset up to which it is packed, rows of a bucket, rows that a task sorts at a time, and rows whose numbers are
# made at a time (or one dataset).
FEW_ROWS = 1 << 18
BUCKET_ROWS = 1 << 19
CHUNK_ROWS = 1 << 20
_AT_ONCE = 1 << 15
# Types whose values are the same after a cast to double.
_WHOLE = (T.ByteType, T.ShortType, T.IntegerType, T.FloatType, T.DoubleType)
STATS = (("n_samples", "bigint"), ("gaps", "bigint"), ("variance", "double"), ("skewness", "double"), ("correlation", "double"),
         ("imbalance", "double"), ("extra", "bigint"), ("flagged", "bigint"))


def packed_features(df: DataFrame, keys: list[str], features: list[str], names: list[str], target: str, rows: int) -> DataFrame:
    """The keys and ``STATS`` of every combination of the keys; ``df`` has about so many rows and normalised nulls.

    ``names`` are the numeric features. Rows are equal if their numbers, the hash of their other features and that of the
    target are.
    """
    flat = text_form(df)
    kinds = {f.name: f.dataType for f in df.schema}
    rest = [c for c in features if c not in names or not isinstance(kinds[c], _WHOLE)]
    hashed = F.xxhash64(F.lit(1), *[quoted(c).isNull() for c in rest], *[quoted(c) for c in rest]) if rest else F.lit(0).cast("long")
    lost = sum((quoted(c).isNull().cast("int") for c in rest if c not in names), F.lit(0))
    buckets = max(1, -(-rows // BUCKET_ROWS))
    cells = flat.select(
        F.pmod(F.xxhash64(F.lit(7), *[quoted(c) for c in keys]), F.lit(buckets)).cast("int").alias("bucket"), *[quoted(c).alias(f"k{i}") for i, c in enumerate(keys)],
        F.when(quoted(target).isNotNull(), F.xxhash64(quoted(target))).alias("class"), hashed.alias("other"), lost.alias("lost"),
        *[quoted(c).cast("double").alias(f"x{i}") for i, c in enumerate(names)])
    k, width = len(keys), len(names)

    def block(part: pa.Table) -> bytes:
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, part.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
            out.write_table(part)
        return sink.getvalue().to_pybytes()

    def sent(waiting: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(waiting)
        at = table.column(0).to_numpy()
        order = np.argsort(at, kind="stable")
        at, table = at[order], table.drop_columns(["bucket"]).take(pa.array(order))
        first = np.flatnonzero(np.append(True, at[1:] != at[:-1]))
        ends = np.append(first[1:], len(at))
        blocks = [block(table.slice(a, b - a).combine_chunks()) for a, b in zip(first.tolist(), ends.tolist())]
        return pa.RecordBatch.from_arrays([pa.array(at[first], pa.int32()), pa.array(blocks, pa.binary())], names=["bucket", "block"])

    def packing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, size = [], 0
        for batch in batches:
            if batch.num_rows:
                waiting.append(batch)
                size += batch.num_rows
            if size >= CHUNK_ROWS:
                yield sent(waiting)
                waiting, size = [], 0
        if waiting:
            yield sent(waiting)

    key_fields = [(f"k{i}", flat.schema[c].dataType) for i, c in enumerate(keys)]
    schema = T.StructType([*[T.StructField(c, t) for c, t in key_fields], *[T.StructField(c, T.LongType() if t == "bigint" else T.DoubleType()) for c, t in STATS]])

    def measured(group: pa.Table) -> pa.Table:
        table = pa.concat_tables([pa.ipc.open_stream(b.as_buffer()).read_all() for b in group.column("block")]).combine_chunks()
        own = [c.chunk(0) for c in table.columns[:k]]
        codes = np.column_stack([c.dictionary_encode(null_encoding="encode").indices.to_numpy() for c in own])
        _, some, which = np.unique(codes, axis=0, return_index=True, return_inverse=True)
        which = which.reshape(-1)
        order = np.argsort(which, kind="stable")
        starts = np.searchsorted(which[order], np.arange(len(some)))
        ends = np.append(starts[1:], len(order))
        seen = ~np.asarray(table.column("class").is_null())[order]
        kind = table.column("class").fill_null(0).to_numpy()[order]
        other, empty = table.column("other").to_numpy()[order], table.column("lost").to_numpy()[order]
        x = np.column_stack([table.column(f"x{i}").to_numpy().astype(float) for i in range(width)])[order] if width else np.empty((len(order), 0))
        found, at = [], 0
        while at < len(starts):
            to = max(at + 1, int(np.searchsorted(ends, starts[at] + _AT_ONCE, side="right")))
            a, b = int(starts[at]), int(ends[to - 1])
            found.append(_measured(x[a:b], kind[a:b], seen[a:b], other[a:b], empty[a:b], starts[at:to] - a))
            at = to
        columns = {name: pa.array(np.concatenate([f[name] for f in found]), pa.int64() if t == "bigint" else pa.float64()) for name, t in STATS}
        for name in ("variance", "skewness", "correlation", "imbalance"):
            there = np.concatenate([f[f"has_{name}"] for f in found])
            columns[name] = pa.array(columns[name].to_numpy(), pa.float64(), mask=~there)
        return pa.Table.from_arrays([*[c.take(pa.array(some)) for c in own], *columns.values()], names=[*[f"k{i}" for i in range(k)], *columns])

    made = cells.mapInArrow(packing, "bucket int, block binary").groupBy("bucket").applyInArrow(measured, schema)
    known = F.lit(True)
    for i in range(k):
        known = known & F.col(f"k{i}").isNotNull()
    # Where a key is null, only what is counted is known.
    return made.select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(keys)], "n_samples", "gaps", *[F.when(known, F.col(c)).alias(c) for c, _ in STATS[2:]])


def _mixed(h: np.ndarray, bits: np.ndarray, by: int) -> np.ndarray:
    """A 64-bit hash with another 64 bits mixed in."""
    h = (h ^ bits) * np.uint64(by)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h ^ h >> np.uint64(32)


def _mean(values: np.ndarray, there: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The mean of the values that are there, by row, and whether there are any."""
    n = there.sum(axis=1)
    return np.where(there, values, 0).sum(axis=1) / np.maximum(n, 1), n > 0


def _measured(x: np.ndarray, kind: np.ndarray, seen: np.ndarray, other: np.ndarray, empty: np.ndarray, starts: np.ndarray) -> dict:
    """The numbers of datasets whose rows begin at ``starts``; NaN is a missing value."""
    groups, width = len(starts), x.shape[1]
    n = np.diff(np.append(starts, len(x)))
    which = np.repeat(np.arange(groups), n)
    there = ~np.isnan(x)
    out = {"n_samples": n, "gaps": np.add.reduceat(empty.astype(np.int64) + (~there).sum(axis=1), starts)}
    with np.errstate(all="ignore"):
        known = np.add.reduceat(there, starts, axis=0, dtype=np.int64)
        mean = np.add.reduceat(np.where(there, x, 0), starts, axis=0) / np.maximum(known, 1)
        z = np.where(there, x - mean[which], 0)
        second, third = np.add.reduceat(z * z, starts, axis=0), np.add.reduceat(z * z * z, starts, axis=0)
        low = np.minimum.reduceat(np.where(there, x, np.inf), starts, axis=0)
        high = np.maximum.reduceat(np.where(there, x, -np.inf), starts, axis=0)
        out["variance"], out["has_variance"] = _mean(second / (known - 1), known > 1)
        skew = np.abs(np.sqrt(known) * third / second ** 1.5)
        out["skewness"], out["has_skewness"] = _mean(skew, (known > 0) & (low != high))
        if width > 1:
            m = R._grouped(x, starts)
            r = m[R._PRODUCTS] / np.sqrt(m[R._SQUARES] * m[R._SQUARES].swapaxes(1, 2))
            spread = m[R._LOW] < m[R._HIGH]
            upper = np.triu_indices(width, 1)
            defined = (np.isfinite(r) & spread & spread.swapaxes(1, 2))[:, upper[0], upper[1]]
            out["correlation"], out["has_correlation"] = _mean(np.abs(np.clip(r[:, upper[0], upper[1]], -1, 1)), defined)
        else:
            out["correlation"], out["has_correlation"] = np.zeros(groups), np.ones(groups, dtype=bool)
        outside = np.zeros(len(x), dtype=bool)
        for j in range(width):
            v = x[np.lexsort((x[:, j], which)), j]  # missing ones last in each dataset
            ends = []
            for share in (0.25, 0.75):
                place = np.maximum(known[:, j] - 1, 0) * share
                floor = np.floor(place)
                a, b = v[starts + floor.astype(int)], v[starts + np.ceil(place).astype(int)]
                ends.append(a + (b - a) * (place - floor))
            q1, q3 = ends
            reach = (q3 - q1) * K.FENCE_FACTOR
            fenced = (known[:, j] >= 4) & ((q3 > q1) | (np.isnan(q3) & ~np.isnan(q1)))  # NaN is largest, as in Spark
            below, above = (q1 - reach)[which], (q3 + reach)[which]
            outside |= there[:, j] & fenced[which] & ((x[:, j] < below) | np.isnan(below) | (x[:, j] > above))
    out["flagged"] = np.add.reduceat(outside.astype(np.int64), starts)

    def runs(order: np.ndarray, *values: np.ndarray) -> np.ndarray:
        """Where another dataset or value begins in rows of this order."""
        new = np.zeros(len(order), dtype=bool)
        new[:1] = True
        for v in (which, *values):
            new[1:] |= v[order][1:] != v[order][:-1]
        return np.flatnonzero(new)

    named = np.flatnonzero(seen)
    order = named[np.lexsort((kind[named], which[named]))]
    first = runs(order, kind)
    top = np.zeros(groups, dtype=np.int64)
    np.maximum.at(top, which[order[first]], np.diff(np.append(first, len(order))))
    total = np.add.reduceat(seen.astype(np.int64), starts)
    out["imbalance"], out["has_imbalance"] = top / np.maximum(total, 1), total > 0

    bits = np.where(there, x + 0.0, np.nan).view(np.uint64)
    hashes = []
    for by in (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93):
        h = np.full(len(x), by, dtype=np.uint64)
        for part in (other.view(np.uint64), kind.view(np.uint64), seen.astype(np.uint64), *bits.T):
            h = _mixed(h, part, by)
        hashes.append(h)
    order = np.lexsort((*hashes, which))
    out["extra"] = n - np.bincount(which[order[runs(order, *hashes)]], minlength=groups)
    return out
