"""Logistic regression by Newton steps: a dozen or two passes over the rows, each with the same few sums per partition.

L-BFGS takes hundreds of passes where classes can be told apart, as the coefficients of such classes grow until the
penalty stops them. A Newton step also needs the second derivatives, a square matrix of all coefficients. It is small while
there are few features and classes; ``MOST_COEFFICIENTS`` says up to where it is used.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablegauge.functions.nulls import quoted, sql_name
from tablegauge.functions.session import written

MOST_COEFFICIENTS = 256
MOST_STEPS = 100
# The step is the last one if it is expected to lower the loss by no more than this share.
TOLERANCE = 1e-10
# Rows whose probabilities and derivatives are at hand at a time, and bytes of partial sums that one task merges.
_ROWS = 4096
_MERGE_BYTES = 32 << 20
_PARTIAL = "at bigint, sums binary"


def _blocks(df: DataFrame, names: list[str], label: str) -> tuple[DataFrame, int]:
    """The rows as matrices of label, features and a one, fixed for the passes, and the width of these.

    A matrix is kept column by column, as like numbers next to each other compress well.
    """
    width = len(names) + 2

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = np.column_stack([*[c.to_numpy(zero_copy_only=False).astype(float) for c in batch.columns], np.ones(batch.num_rows)])
                yield pa.RecordBatch.from_pydict({"block": pa.array([x[i:i + _ROWS].tobytes(order="F") for i in range(0, len(x), _ROWS)], pa.binary())})

    cells = df.select(quoted(label).cast("double").alias("y"), *[quoted(c).cast("double").alias(f"x{i}") for i, c in enumerate(names)])
    return written(cells.mapInArrow(packed, "block binary"), "blocks"), width


def _sums(block: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Loss, first and second derivatives of some rows, flat. Two classes have one vector of coefficients, more have one each."""
    y, x = block[:, 0].astype(int), block[:, 1:]
    with np.errstate(all="ignore"):
        scores = x @ w.T
        if len(w) == 1:  # the first class has the score zero
            scores = np.column_stack([np.zeros(len(x)), scores])
        scores -= scores.max(axis=1, keepdims=True)
        p = np.exp(scores)
        total = p.sum(axis=1, keepdims=True)
        loss = float((np.log(total[:, 0]) - scores[np.arange(len(y)), y]).sum())
        p /= total
        off = p.copy()
        off[np.arange(len(y)), y] -= 1
        first = scores.shape[1] - len(w)
        g = (p[:, first:, None] * x[:, None, :]).reshape(len(x), -1)
        slope = off[:, first:].T @ x
        bend = -(g.T @ g)
        d = x.shape[1]
        own = g.T @ x
        for k in range(len(w)):
            bend[k * d:(k + 1) * d, k * d:(k + 1) * d] += own[k * d:(k + 1) * d]
    return np.concatenate([[loss], slope.ravel(), bend.ravel()])


def _pass(blocks: DataFrame, width: int, w: np.ndarray) -> np.ndarray:
    """The sums over all rows, those of each partition made by its task."""
    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for b in batch.column(0):
                own = _sums(np.frombuffer(b.as_buffer(), dtype=float).reshape(width, -1).T, w)
                total = own if total is None else total + own
        if total is not None:
            yield pa.RecordBatch.from_pydict({"at": [TaskContext.get().partitionId()], "sums": [total.tobytes()]})

    def merge(key: tuple, group: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(b.as_buffer(), dtype=float) for b in group.sort_by("at").column("sums"))
        return pa.Table.from_pydict({"at": [key[0].as_py()], "sums": [total.tobytes()]})

    parts = blocks.mapInArrow(partial, _PARTIAL)
    fan = max(2, _MERGE_BYTES // (8 * (w.size + 1) ** 2))
    left = blocks.rdd.getNumPartitions()
    while left > fan:
        parts = parts.groupBy(F.floor(F.col("at") / fan).cast("bigint").alias("to")).applyInArrow(merge, _PARTIAL)
        left = -(-left // fan)
    rows = sorted(parts.collect(), key=lambda r: r["at"])  # at most ``fan``
    return sum(np.frombuffer(bytes(r["sums"]), dtype=float) for r in rows)


def newton(df: DataFrame, names: list[str], label: str, counts: list[int], strength: float) -> np.ndarray | None:
    """Coefficients of a regression with an L2 penalty, a row per class with the intercept last; for two classes one row.

    The loss is the mean over the rows, plus ``strength`` times half the squared coefficients without the intercepts.
    ``counts`` are the rows of each class. None where this method is not for the table: a class without rows, cells that are
    no finite numbers, or more than ``MOST_COEFFICIENTS``.
    """
    vectors = 1 if len(counts) == 2 else len(counts)
    if len(counts) < 2 or min(counts) == 0 or vectors * (len(names) + 1) > MOST_COEFFICIENTS:
        return None
    n, d = sum(counts), len(names) + 1
    w = np.zeros((vectors, d))
    w[:, -1] = np.log(counts[1] / counts[0]) if vectors == 1 else np.log(np.array(counts) / n)
    penalty = np.tile(np.append(np.full(d - 1, strength), 0.0), vectors)
    # One number added to all intercepts changes nothing; this makes the matrix regular without moving the rest.
    level = np.tile(np.append(np.zeros(d - 1), 1.0), vectors)
    regular = np.outer(level, level) / vectors if vectors > 1 else 0.0
    blocks, width = _blocks(df, names, label)

    def at(v: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        sums = _pass(blocks, width, v.reshape(vectors, d)) / n
        slope, bend = sums[1:v.size + 1], sums[v.size + 1:].reshape(v.size, v.size)
        return sums[0] + float(penalty @ (v * v)) / 2, slope + penalty * v, bend + np.diag(penalty) + regular

    here = w.ravel()
    loss, slope, bend = at(here)
    for _ in range(MOST_STEPS):
        if not (np.isfinite(loss) and np.isfinite(slope).all() and np.isfinite(bend).all()):
            return None
        step = -np.linalg.lstsq(bend, slope, rcond=None)[0]
        gain = -float(slope @ step)
        if gain / 2 <= TOLERANCE * loss:
            here = here + step
            break
        share, found = 1.0, at(here + step)
        while share > 1e-6 and not found[0] <= loss - 1e-4 * share * gain:
            share /= 2
            found = at(here + share * step)
        here, (loss, slope, bend) = here + share * step, found
    return here.reshape(vectors, d)


def predicted(df: DataFrame, names: list[str], w: np.ndarray) -> DataFrame:
    """``df`` with ``prediction``, the class of the largest score."""
    def score(v: np.ndarray) -> str:
        return " + ".join([f"{float(v[-1])!r}D", *[f"{float(b)!r}D * {sql_name(c)}" for c, b in zip(names, v)]])

    scores = F.array(*[F.expr(score(v)) for v in w])
    if len(w) == 1:
        scores = F.array(F.lit(0.0), F.expr(score(w[0])))
    best = F.array_position(F.col("__scores"), F.array_max("__scores")) - 1
    return df.withColumn("__scores", scores).withColumn("prediction", best.cast("double")).drop("__scores")
