"""Hard negatives: texts of another label that score nearly as high as a positive, found through one-bit codes.

A vector of integers is rotated, and the signs are its code; stored with it is how well the code vector (the signs, brought to length
one) is aligned with the vector. What the code leaves is rotated and coded in the same way, a few times. An anchor is rounded to some
bits a coordinate, so that a few population counts give its product with a code vector. What the last code leaves of a vector
has a known length and stands at right angles to it, so the Cauchy-Schwarz inequality bounds what it can add: every score
lies in a known interval, without any chance. Only rows whose interval reaches what is asked for are scored, in integers.

Anchors meet all rows in blocks: a task holds some anchors and lets its share of the rows pass by.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema

from tablegauge.llm.common import staged

#: Anchors that a task holds, and the shares that the rows are dealt out in; an anchor gets its best from each share.
ANCHORS, SHARES = 8_192, 32
#: Anchors and rows compared at a time.
TILE_ANCHORS, TILE_ROWS = 128, 4_096
#: Codes of a vector, each of what the ones before leave; bits a coordinate of an anchor is rounded to.
CODES, PLANES = 4, 7
#: Partitions that the blocks are dealt out to, at most.
PARTITIONS = 100_000
#: Part of an interval added for rounding of floating-point numbers.
SLACK = 1e-9
LEAST, MOST = -(2**63), 2**63 - 1

CODED = pa.schema([("vec_id", pa.int64()), ("label", pa.int64()), ("size", pa.int32()), ("norm", pa.float64()), ("aligned", pa.binary()), ("code", pa.binary()), ("vector", pa.binary())])
FOUND = pa.schema([("anchor_id", pa.int64()), ("positive_id", pa.int64()), ("positive_score", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])


@lru_cache(maxsize=16)
def rotation(size: int, nth: int) -> np.ndarray:
    """A rotation of this many dimensions, drawn once and for all."""
    return np.linalg.qr(np.random.default_rng([size, nth]).standard_normal((size, size)))[0]


def whole(x: float, scale: int) -> int:
    """``floor(scale x)`` of any finite number."""
    return math.floor(scale * x) if abs(x) < 2.0**60 else int(x) * scale


def directed(z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lengths of the rows, and the rows brought to length one; a length is infinite where it can't be told."""
    with np.errstate(all="ignore"):
        norm = np.linalg.norm(z, axis=1)
        good = np.isfinite(norm) & (norm > 0)
        unit = np.where(good[:, None], z / np.where(good, norm, 1)[:, None], 0)
    return np.where(np.isfinite(norm), norm, np.inf), unit


def codes_of(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The codes of each row, one after the other, and their alignments followed by the length of what is left."""
    left, size, codes, aligned = unit, unit.shape[1], [], []
    for nth in range(CODES):
        y = left @ rotation(size, nth)
        codes.append(packed(y >= 0))
        aligned.append(np.abs(y).sum(axis=1) / math.sqrt(size))
        left = (y - np.where(y >= 0, 1, -1) * (aligned[-1] / math.sqrt(size))[:, None]) @ rotation(size, nth).T
    return np.column_stack(codes), np.column_stack([*aligned, np.linalg.norm(left, axis=1)])


def coded(rows: DataFrame, scale: int) -> DataFrame:
    """vec_id, label, size, norm, aligned, code, vector of the rows (vec_id, label, vector)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, labels, vectors = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False), batch.column(2)
            sizes = pa.compute.list_value_length(vectors).to_numpy(zero_copy_only=False)
            flat, ends = vectors.flatten().to_numpy(zero_copy_only=False), np.cumsum(sizes)
            for size in np.unique(sizes).tolist():
                at = np.flatnonzero(sizes == size)
                x = flat[(ends[at] - size)[:, None] + np.arange(size)]
                with np.errstate(over="ignore"):
                    norm, unit = directed(np.floor(scale * x))
                codes, aligned = codes_of(unit)
                yield pa.RecordBatch.from_arrays([
                    pa.array(ids[at], type=pa.int64()), pa.array(labels[at], type=pa.int64()), pa.array([size] * len(at), type=pa.int32()), pa.array(norm),
                    *[pa.array([v.tobytes() for v in part], type=pa.binary()) for part in (aligned, codes, x)]], schema=CODED)

    return rows.select("vec_id", "label", "vector").mapInArrow(run, from_arrow_schema(CODED))


def packed(signs: np.ndarray) -> np.ndarray:
    """Bits in words of 64, the last filled up with zeros."""
    n, size = signs.shape
    full = np.zeros((n, -(-max(1, size) // 64) * 64), dtype=bool)
    full[:, :size] = signs
    return np.packbits(full, axis=1).view(np.uint64)


class Vectors:
    """Some coded vectors of one length."""

    def __init__(self, batch: pa.RecordBatch, scale: int):
        column = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
        self.ids, self.labels = (column[c].to_numpy(zero_copy_only=False) for c in ("vec_id", "label"))
        self.norm, self.scale = column["norm"].to_numpy(zero_copy_only=False), scale
        self.code, self.aligned, self.x = (np.stack([np.frombuffer(b, dtype=kind) for b in column[c].to_pylist()]) for c, kind in (("code", np.uint64), ("aligned", np.float64), ("vector", np.float64)))
        with np.errstate(over="ignore"):
            self.z = np.floor(scale * self.x)
        self.largest = np.abs(self.z).max(axis=1, initial=0)

    def whole(self, i: int) -> list[int]:
        return [whole(v, self.scale) for v in self.x[i].tolist()]


class Rounded:
    """Directions in one rotation, rounded to ``PLANES`` bits a coordinate: products with codes are sums of population counts."""

    def __init__(self, unit: np.ndarray, nth: int):
        turned = unit @ rotation(unit.shape[1], nth)
        self.low = turned.min(axis=1, initial=0)
        self.step = np.maximum((turned.max(axis=1, initial=0) - self.low) / (2**PLANES - 1), 1e-300)
        levels = np.clip(np.rint((turned - self.low[:, None]) / self.step[:, None]), 0, 2**PLANES - 1)
        near = self.low[:, None] + levels * self.step[:, None]
        self.error, self.sum, self.root = np.linalg.norm(turned - near, axis=1), near.sum(axis=1), math.sqrt(unit.shape[1])
        self.planes = [packed((levels.astype(np.int64) >> j & 1).astype(bool)) for j in range(PLANES)]

    def products(self, a: int, b: int, code: np.ndarray) -> np.ndarray:
        """About the products of the directions ``a`` to ``b`` with the code vectors; they are off by ``error`` at most."""
        ones, counts = np.bitwise_count(code).sum(axis=1, dtype=np.int32), np.zeros((b - a, len(code)), dtype=np.int32)
        for j, plane in enumerate(self.planes):
            for w in range(code.shape[1]):
                counts += np.bitwise_count(plane[a:b, w][:, None] & code[:, w]).astype(np.int32) << j
        on = self.low[a:b, None] * ones + self.step[a:b, None] * counts
        return (2 * on - self.sum[a:b, None]) / self.root


class Asked:
    """Anchors and the bounds of their scores."""

    def __init__(self, own: Vectors):
        self.own = own
        self.turned = [Rounded(directed(own.z)[1], nth) for nth in range(CODES)]

    def intervals(self, a: int, b: int, rows: Vectors, some: slice) -> tuple[np.ndarray, np.ndarray]:
        """Least and greatest possible score of the anchors ``a`` to ``b`` with the rows."""
        code, aligned = rows.code[some], rows.aligned[some]
        width = code.shape[1] // CODES
        with np.errstate(all="ignore"):
            middle, away = np.zeros((b - a, len(code))), np.full((b - a, len(code)), SLACK)
            for nth, turned in enumerate(self.turned):
                near, error = turned.products(a, b, code[:, nth * width:(nth + 1) * width]), turned.error[a:b, None]
                middle += aligned[:, nth] * near
                away += aligned[:, nth] * error
            # What is left stands at right angles to the last code vector.
            away += aligned[:, CODES] * np.sqrt(np.maximum(0, 1 - np.maximum(0, np.abs(near) - error) ** 2))
            lengths = self.own.norm[a:b, None] * rows.norm[some]
            low, high = (middle - away * (1 + SLACK)) * lengths, (middle + away * (1 + SLACK)) * lengths
        # Scores are cut to 64 bits, and so are their bounds.
        return tuple(np.clip(np.where(np.isfinite(x), x, open_end), LEAST, MOST) for x, open_end in ((low, -np.inf), (high, np.inf)))

    def scores(self, i: int, rows: Vectors, at: np.ndarray) -> np.ndarray:
        """The integer products of anchor ``i`` with some rows, cut to 64 bits."""
        z = rows.z.shape[1]
        with np.errstate(all="ignore"):
            exact = max(1, z) * rows.largest[at] * self.own.largest[i] < 2.0**53
        out = np.zeros(len(at), dtype=np.int64)
        out[exact] = (rows.z[at[exact]] @ self.own.z[i]).astype(np.int64)
        if not exact.all():
            mine = self.own.whole(i)
            for k in np.flatnonzero(~exact).tolist():
                out[k] = min(MOST, max(LEAST, sum(u * v for u, v in zip(mine, rows.whole(at[k])))))
        return out


def best(ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((ids, -scores.astype(object) if len(scores) and scores.min() == LEAST else -scores))[:k]
    return ids[order], scores[order]


def kth(values: np.ndarray, k: int) -> float:
    """The ``k``-th largest value, or below all numbers if there are fewer."""
    return np.partition(values, len(values) - k)[len(values) - k] if len(values) >= k else -np.inf


class Search:
    """The best rows so far of every range of scores that an anchor asks for."""

    def __init__(self, anchors: Vectors, asked: list[list[tuple[int, int, int]]], same: bool, k: int):
        #: By anchor: (positive, its score, least score asked for); the greatest is the positive's.
        self.anchors, self.asked, self.same, self.k = Asked(anchors), asked, same, k
        self.held = [[(np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)) for _ in ranges] for ranges in asked]

    def pass_by(self, rows: Vectors) -> None:
        own = self.anchors.own
        for first in range(0, len(rows.ids), TILE_ROWS):
            some = slice(first, first + TILE_ROWS)
            for a in range(0, len(own.ids), TILE_ANCHORS):
                b = min(len(own.ids), a + TILE_ANCHORS)
                low, high = self.anchors.intervals(a, b, rows, some)
                fit = (rows.labels[some] == own.labels[a:b, None]) == self.same
                fit &= rows.ids[some] != own.ids[a:b, None]
                for i in range(a, b):
                    self.one(i, rows, first, np.flatnonzero(fit[i - a]), low[i - a], high[i - a])

    def one(self, i: int, rows: Vectors, first: int, fit: np.ndarray, low: np.ndarray, high: np.ndarray) -> None:
        if not len(fit):
            return
        low, high = low[fit], high[fit]
        reached = []
        for (ids, scores), (_, top, floor) in zip(self.held[i], self.asked[i]):
            inside = low[(low >= floor) & (high <= top)]  # surely in the range: the k-th of these is a bound for the result
            least = max(float(floor), kth(inside, self.k), float(scores[-1]) if len(scores) == self.k else -np.inf)
            reached.append((high >= least) & (low <= top))
        at = np.flatnonzero(np.logical_or.reduce(reached))
        if not len(at):
            return
        scores, ids = self.anchors.scores(i, rows, first + fit[at]), rows.ids[first + fit[at]]
        for j, (_, top, floor) in enumerate(self.asked[i]):
            held, fits = self.held[i][j], (scores >= floor) & (scores <= top)
            if fits.any():
                self.held[i][j] = best(np.concatenate([held[0], ids[fits]]), np.concatenate([held[1], scores[fits]]), self.k)

    def result(self) -> Iterator[pa.RecordBatch]:
        rows = [(anchor, positive, top, i, s) for anchor, ranges, held in zip(self.anchors.own.ids.tolist(), self.asked, self.held)
                for (positive, top, _), (ids, scores) in zip(ranges, held) for i, s in zip(ids.tolist(), scores.tolist())]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows), FOUND)], schema=FOUND)


def searched(same: bool, k: int, low: int, high: int, scale: int) -> Callable:
    """Runs through blocks, each the anchors (kind 0) and then the rows (kind 1)."""

    def ranges(positives: list[dict] | None) -> list[tuple[int, int, int]]:
        if positives is None:
            return [(-1, MOST, LEAST)]
        return [(p["vec_id"], min(MOST, high * p["score"] // 100), max(LEAST, -(-low * p["score"] // 100))) for p in positives]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, waiting, search = None, [], None
        for batch in batches:
            keys = np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in range(4)], axis=1)
            cuts = np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(keys)]):
                if a == b:
                    continue
                part, here = batch.slice(a, b - a), tuple(keys[a, :3].tolist())
                if here != block:
                    if search:
                        yield from search.result()
                    block, waiting, search = here, [], None
                if keys[a, 3] == 0:
                    waiting.append(part)
                    continue
                if waiting:
                    anchors = pa.Table.from_batches(waiting).combine_chunks().to_batches()[0]
                    search = Search(Vectors(anchors, scale), [ranges(p) for p in anchors.column(anchors.schema.get_field_index("positives")).to_pylist()], same, k)
                    waiting = []
                if search:
                    search.pass_by(Vectors(part, scale))
        if search:
            yield from search.result()

    return run


def met(vectors: DataFrame, anchors: DataFrame, n_anchors: int, same: bool, k: int, low: int, high: int, scale: int) -> DataFrame:
    """anchor_id, positive_id, positive_score, vec_id, score: up to ``k`` rows of each share for each range."""
    groups, names = max(1, -(-n_anchors // ANCHORS)), [*CODED.names, "positives"]
    every = F.sequence(F.lit(0), F.lit(SHARES - 1)), F.sequence(F.lit(0), F.lit(groups - 1))
    held = anchors.select("size", F.pmod(F.xxhash64("vec_id"), F.lit(groups)).cast("int").alias("grp"), F.explode(every[0]).alias("share"), F.lit(0).alias("kind"), *[c for c in names if c != "size"])
    passing = vectors.withColumn("positives", F.lit(None).cast(anchors.schema["positives"].dataType)).select(
        "size", F.explode(every[1]).alias("grp"), F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(SHARES)).cast("int").alias("share"), F.lit(1).alias("kind"), *[c for c in names if c != "size"])
    blocks = held.unionByName(passing).repartition(min(PARTITIONS, groups * SHARES), "size", "grp", "share").sortWithinPartitions("size", "grp", "share", "kind")
    return blocks.mapInArrow(searched(same, k, low, high, scale), from_arrow_schema(FOUND))


def firsts(found: DataFrame, k: int) -> DataFrame:
    """The best ``k`` of each range with ``rank``; there are at most ``k`` of each share."""
    order = Window.partitionBy("anchor_id", "positive_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def hard_negatives(rows: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100, scale: int = 256,
                   id_column: str = "vec_id", label: str = "label", vector: str = "embedding") -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    A component ``x`` becomes ``floor(scale x)``; the score of two rows is their integer product, cut to 64 bits. ``is_anchor`` is a
    condition on ``vec_id``. An anchor's positives are the ``positives`` other rows of its label that score highest with it; for each of
    them the first ``negatives`` rows of other labels follow that score between ``low`` and ``high`` per cent of the positive. Ties go to the smaller id.
    Rows without id or label, and vectors that are null or hold null or non-finite numbers take no part; a zero vector scores zero, an empty vector is left out.
    Rows that repeat an id count once, with the least label and then vector. Vectors of different length do not meet.
    """
    x = F.col(vector).cast("array<double>")
    good = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & (F.size(x) > 0)
    usable = rows.select(F.col(id_column).cast("bigint").alias("vec_id"), F.col(label).cast("bigint").alias("label"), x.alias("vector")).where(
        F.col("vec_id").isNotNull() & F.col("label").isNotNull() & good)
    once = usable.groupBy("vec_id").agg(F.min(F.struct("label", "vector")).alias("x")).select("vec_id", "x.label", "x.vector")
    vectors = staged(coded(once, scale), "coded")
    anchors = vectors.where(is_anchor)
    n = anchors.count()
    none = F.lit(None).cast("array<struct<score:bigint,vec_id:bigint>>")
    first = firsts(met(vectors, anchors.withColumn("positives", none), n, True, positives, low, high, scale), positives)
    chosen = staged(first.groupBy("anchor_id").agg(F.collect_list(F.struct("score", F.col("vec_id"))).alias("positives")), "positives")
    asking = anchors.join(chosen.withColumnRenamed("anchor_id", "vec_id"), "vec_id")
    found = firsts(met(vectors, asking, n, False, negatives, low, high, scale), negatives)
    known = chosen.select("anchor_id", F.explode("positives").alias("p")).select("anchor_id", F.col("p.vec_id").alias("positive_id"), F.col("p.score").alias("whole_score"))
    return found.join(known, ["anchor_id", "positive_id"]).select(
        "anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), F.col("whole_score").alias("positive_score"), F.col("score").alias("negative_score"))
