"""Approximate nearest neighbours by a permutation index.

Some vectors far from each other are the pivots. A vector is represented by the order in which it sees
them, nearest first; since long vectors are near to many by inner product, it gets one more coordinate, which brings
all vectors to the same length and is zero in a query. The inverted file of a pivot holds the vectors that have it among their first few; a
query opens the files of the pivots nearest to it, ranks what is posted there by the footrule distance of the
whole permutations, and the best share of them is ranked again by the exact inner product. A vector that a
query meets in several files is ranked in the first of them only.

Files are cut into parts of a bounded size, so a pivot that very many vectors are near to is many tasks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema

from tablegauge.llm.common import staged

#: Vectors from which the pivots are chosen (those with the least hash of their id), and the most pivots.
SAMPLE, PIVOTS = 2_048, 128
#: Files that a vector is posted in, and that a query opens.
POSTED, OPENED = 4, 48
#: Of what a query meets in a part of a file, this share is ranked exactly, and at least so many, and what ties with them.
RERANKED, RERANKED_LEAST = 0.15, 40
#: Vectors and queries in a part of a file.
PART_VECTORS, PART_QUERIES = 4_096, 1_024

POST = pa.schema([("pivot", pa.int32()), ("vec_id", pa.int64()), ("vector", pa.binary())])
FOUND = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])


def usable(rows: DataFrame, id_column: str, vector: str) -> DataFrame:
    """(vec_id, vector): rows with an id and a vector of finite numbers, not all zero; one row per id, the least vector."""
    x = F.col(vector).cast("array<double>")
    good = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists(x, lambda v: v != 0)
    return rows.select(F.col(id_column).cast("bigint").alias("vec_id"), x.alias("vector")).where(F.col("vec_id").isNotNull() & good).groupBy("vec_id").agg(F.min("vector").alias("vector"))


def pivots_of(vectors: DataFrame, sample: int, most: int, longest: float) -> np.ndarray:
    """Unit vectors far from each other, chosen one by one from a bounded sample."""
    rows = vectors.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).collect()
    if not rows:
        return np.zeros((0, 0))
    width = max({len(r["vector"]) for r in rows}, key=[len(r["vector"]) for r in rows].count)
    unit = lifted(np.array([r["vector"] for r in rows if len(r["vector"]) == width]), longest)
    chosen, near = [0], unit @ unit[0]
    while len(chosen) < min(most, len(unit)) and near.min() < 1 - 1e-9:
        chosen.append(int(np.argmin(near)))
        near = np.maximum(near, unit @ unit[chosen[-1]])
    return unit[chosen]


def lifted(x: np.ndarray, longest: float | None) -> np.ndarray:
    """Unit vectors with one more coordinate: of rows no longer than ``longest``, or of queries (None)."""
    if longest is None:
        x = x / np.abs(x).max(axis=1, keepdims=True)  # so that no square overflows
        return np.column_stack([x / np.linalg.norm(x, axis=1, keepdims=True), np.zeros(len(x))])
    x = x / longest
    return np.column_stack([x, np.sqrt(np.maximum(0, 1 - (x * x).sum(axis=1)))])


def places(x: np.ndarray, pivots: np.ndarray, longest: float | None) -> tuple[np.ndarray, np.ndarray]:
    """The pivots of each vector, nearest first, and the place of each pivot in that order."""
    order = np.argsort(-(lifted(x, longest) @ pivots.T), axis=1, kind="stable")
    place = np.empty(order.shape, dtype=np.uint8 if len(pivots) <= 256 else np.uint16)
    np.put_along_axis(place, order, np.arange(len(pivots), dtype=place.dtype)[None, :], axis=1)
    return order, place


def posted(vectors: DataFrame, pivots: np.ndarray, files: int, longest: float | None) -> DataFrame:
    """(pivot, vec_id, vector): each vector once for each of its nearest pivots."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, rows = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_pylist()
            fit = [i for i, r in enumerate(rows) if len(r) == pivots.shape[1] - 1]
            for at in range(0, len(fit), 1024):
                some = fit[at:at + 1024]
                x = np.array([rows[i] for i in some])
                near = places(x, pivots, longest)[0][:, :files]
                blobs = [v.tobytes() for v in x]
                yield pa.RecordBatch.from_arrays([
                    pa.array(near.reshape(-1), type=pa.int32()), pa.array(np.repeat(ids[some], near.shape[1]), type=pa.int64()),
                    pa.array([b for b in blobs for _ in range(near.shape[1])], type=pa.binary())], schema=POST)

    return vectors.select("vec_id", "vector").mapInArrow(run, from_arrow_schema(POST))


def ranked_part(pivots: np.ndarray, files: int, opened: int, share: float, least: int, k: int, longest: float) -> Callable:
    """Ranks the queries of a part of a file among its vectors."""

    def run(key: tuple, posts: pa.Table, asks: pa.Table) -> pa.Table:
        if not posts.num_rows or not asks.num_rows:
            return FOUND.empty_table()
        posts, asks, pivot = posts.sort_by("vec_id"), asks.sort_by("vec_id"), key[0].as_py()
        ids, x = posts.column("vec_id").to_numpy(), np.stack([np.frombuffer(b, dtype=np.float64) for b in posts.column("vector").to_pylist()])
        own, q = asks.column("vec_id").to_numpy(), np.stack([np.frombuffer(b, dtype=np.float64) for b in asks.column("vector").to_pylist()])
        order, place = places(x, pivots, longest)
        asked = places(q, pivots, None)[1]
        out: list[tuple] = []
        for i in range(len(own)):
            # Not here if the query opens an earlier file that the vector is posted in.
            earlier = (asked[i][order[:, :files]] < opened) & (np.arange(files) < place[:, [pivot]])
            some = np.flatnonzero(~earlier.any(axis=1) & (ids != own[i]))
            if not len(some):
                continue
            there = place[some]
            footrule = (np.maximum(there, asked[i]) - np.minimum(there, asked[i])).sum(axis=1, dtype=np.int32)
            kept = max(least, k, int(np.ceil(share * len(some))))
            if kept < len(some):
                # All that tie with the last one kept, so that pivots which tell vectors apart badly lose nothing.
                some = some[footrule <= np.partition(footrule, kept - 1)[kept - 1]]
            scores = (x[some] * q[i]).sum(axis=1)
            best = np.lexsort((ids[some], -scores))[:k]
            out.append((np.full(len(best), own[i]), ids[some][best], scores[best]))
        if not out:
            return FOUND.empty_table()
        return pa.Table.from_arrays([pa.array(np.concatenate(c), type=f.type) for c, f in zip(zip(*out), FOUND)], schema=FOUND)

    return run


def by_pivot(counts: dict[int, int], size: int) -> Column:
    """Number of parts of this size for each pivot."""
    parts = F.create_map(*[F.lit(v) for p, n in counts.items() for v in (p, -(-n // size))])
    return F.coalesce(F.element_at(parts, F.col("pivot")), F.lit(1)).cast("bigint")


def search(vectors: DataFrame, queries: DataFrame, pivots: np.ndarray, k: int, opened: int, share: float, least: int, longest: float) -> DataFrame:
    """(query_id, vec_id, score): the best found of each query, up to ``k`` from each part of a file."""
    files, opened = min(POSTED, len(pivots)), min(opened, len(pivots))
    posts, asks = staged(posted(vectors, pivots, files, longest), "posts"), staged(posted(queries, pivots, opened, None), "asks")
    sizes = [{r["pivot"]: r["count"] for r in rows.groupBy("pivot").count().collect()} for rows in (posts, asks)]  # one row per pivot
    if not sizes[0] or not sizes[1]:
        return posts.sparkSession.createDataFrame([], from_arrow_schema(FOUND))
    n_vectors, n_queries = by_pivot(sizes[0], PART_VECTORS), by_pivot(sizes[1], PART_QUERIES)
    posts = posts.select("*", F.pmod(F.xxhash64("vec_id"), n_vectors).alias("part"), F.explode(F.sequence(F.lit(0).cast("bigint"), n_queries - 1)).alias("turn"))
    asks = asks.select("*", F.explode(F.sequence(F.lit(0).cast("bigint"), n_vectors - 1)).alias("part"), F.pmod(F.xxhash64("vec_id"), n_queries).alias("turn"))
    keys = ["pivot", "part", "turn"]
    return posts.groupBy(*keys).cogroup(asks.groupBy(*keys)).applyInArrow(
        ranked_part(pivots, files, opened, share, least, k, longest), from_arrow_schema(FOUND))


def nearest(rows: DataFrame, is_query: Column, k: int = 20, id_column: str = "vec_id", vector: str = "embedding", sample: int = SAMPLE,
            most_pivots: int = PIVOTS, opened: int = OPENED, share: float = RERANKED, least: int = RERANKED_LEAST) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` rows of largest inner product found for each query row.

    ``is_query`` is a condition on ``vec_id``; all rows are candidates, but not for the query with their own id.
    Rows without an id, and vectors that are null, zero, of another length than most of the sample, or
    hold null or non-finite numbers take no part. Rows that repeat an id count once, with the least of their vectors.
    Ties go to the smaller id. A query that meets fewer than ``k`` candidates opens all files and ranks
    exactly all that is posted there, which is everything.
    """
    vectors = staged(usable(rows, id_column, vector), "vectors")
    largest = F.array_max(F.transform("vector", lambda v: F.abs(v)))
    norm = largest * F.sqrt(F.aggregate("vector", F.lit(0.0), lambda a, v: a + (v / largest) * (v / largest)))
    longest = vectors.agg(F.max(norm)).first()[0]
    pivots = pivots_of(vectors, sample, most_pivots, longest)
    if not len(pivots):
        return vectors.select(F.col("vec_id").alias("query_id"), F.lit(1).alias("rank"), "vec_id", F.lit(0.0).alias("score")).limit(0)
    vectors = vectors.where(F.size("vector") == pivots.shape[1] - 1)
    queries = vectors.where(is_query)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")

    def top(found: DataFrame) -> DataFrame:
        return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

    found = staged(top(search(vectors, queries, pivots, k, opened, share, least, longest)), "found")
    enough = min(k, vectors.count() - 1)
    full = found.groupBy("query_id").count().where(F.col("count") >= enough).select(F.col("query_id").alias("vec_id"))
    short = staged(queries.join(full, "vec_id", "left_anti"), "short")
    if enough < 1 or short.isEmpty():
        return found
    again = top(search(vectors, short, pivots, k, len(pivots), 1.0, least, longest))
    return found.join(full.withColumnRenamed("vec_id", "query_id"), "query_id", "left_semi").unionByName(again)
