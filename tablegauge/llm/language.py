"""Language identification by the nearest of several centroids per language.

A text is the vector of its letter n-grams, hashed, weighted by TF-IDF and normalised. The vectors of a bounded
number of labelled documents per language are clustered; the centroids of the clusters are the model. A
text belongs to the language of the centroid with the largest cosine. If even that one is farther than
nearly all learned texts of its cluster, with a margin, the text is rejected as no known language. A text of few
different n-grams is far from any centroid, so cosines are compared per root of their number, up to ``FULL``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema, to_arrow_schema

from tablegauge.llm.common import arrow_table, text_groups

GROUP_BYTES = 4 << 20
#: Hashed n-grams of one, two and three letters.
DIMENSIONS = 1 << 12
#: Labelled documents learned from, per language, at most: those with the least hash of their id.
LEARNED = 400
#: Centroids per language.
CENTROIDS = 4
#: A text is rejected if its cosine is below the margin's share of this quantile of the cosines of the learned texts
#: nearest to the same centroid; where those are fewer than ``ENOUGH``, of all learned texts of the language.
QUANTILE, MARGIN, ENOUGH = 0.01, 0.8, 100
#: From so many different n-grams on, the cosine does not depend on their number.
FULL = 400
#: Only the most frequent labels, so many, are languages.
LABELS = 2_000
UNKNOWN = "und"
#: Letters of a long text that are counted at a time.
BLOCK = 1 << 20

PREDICTED = pa.schema([("doc_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64()), ("rejected", pa.bool_())])
LEARNING = pa.schema([("doc_id", pa.int64()), ("lang", pa.string()), ("counts", pa.binary())])


@lru_cache(maxsize=1)
def letters() -> np.ndarray:
    """Whether each code point is a letter."""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), dtype=bool, count=0x110000)


def counts(text: str) -> np.ndarray | None:
    """How often each hashed n-gram of letters occurs; words are set apart by a space. None without letters."""
    total, tail, any_letter = np.zeros(DIMENSIONS, dtype=np.int64), np.array([32], dtype=np.uint32), False
    for i in range(0, len(text), BLOCK):
        codes = np.frombuffer(text[i:i + BLOCK].lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        word = letters()[codes]
        any_letter |= bool(word.any())
        codes = np.concatenate([tail, np.where(word, codes, np.uint32(32))])
        codes = codes[np.concatenate([[True], (codes[1:] != 32) | (codes[:-1] != 32)])]
        if not i:
            codes = np.concatenate([tail, codes])  # so that the first letter ends an n-gram as well
        one, two, three = codes[:-2], codes[1:-1], codes[2:]
        pair = one * np.uint32(0x9E3779B1) + two * np.uint32(0x85EBCA77)
        for hashed in (three * np.uint32(0xC2B2AE3D), pair, pair * np.uint32(0x27D4EB2F) + three * np.uint32(0x165667B1)):
            mixed = (hashed ^ (hashed >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
            total += np.bincount(mixed >> np.uint32(32 - 12), minlength=DIMENSIONS)
        tail = codes[-2:]
    return total if any_letter else None


def weighted(rows: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """TF-IDF vectors of length one."""
    out = np.log1p(rows.astype(np.float32)) * idf
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)


def attainable(rows: np.ndarray) -> np.ndarray:
    """The share of a long text's cosine that texts with these n-grams can have."""
    return np.sqrt(np.minimum(1.0, (rows > 0).sum(axis=1) / FULL))


@dataclass
class Model:
    """Centroids, the language of each, and the cosine below which a long text is rejected."""

    langs: list[str]
    centroids: np.ndarray
    floors: np.ndarray
    idf: np.ndarray

    def predict(self, texts: list[str | None]) -> list[tuple[str, float, bool]]:
        """(language, cosine, rejected) of each text."""
        out: list[tuple[str, float, bool]] = [(UNKNOWN, 0.0, True)] * len(texts)
        rows = [(i, c) for i, t in enumerate(texts) if t for c in [counts(t)] if c is not None]
        for at in range(0, len(rows) if self.langs else 0, 256):
            part = rows[at:at + 256]
            found = np.stack([c for _, c in part])
            cosines = weighted(found, self.idf) @ self.centroids.T
            for (i, _), row, share in zip(part, cosines, attainable(found)):
                best = int(np.argmax(row))
                out[i] = (self.langs[best], float(min(1.0, max(0.0, row[best]))), bool(row[best] < self.floors[best] * share))
        return out


def clustered(rows: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Up to ``k`` centroids of the unit rows by spherical k-means, begun from rows far from each other."""
    seeds = [rows.mean(axis=0)]
    seeds = [rows[int(np.argmax(rows @ seeds[0]))]]
    while len(seeds) < min(k, len(rows)):
        nearest = np.max(rows @ np.stack(seeds).T, axis=1)
        seeds.append(rows[int(np.argmin(nearest))])
    centres = np.stack(seeds)
    for _ in range(rounds):
        own = np.argmax(rows @ centres.T, axis=1)
        centres = np.stack([rows[own == j].mean(axis=0) if (own == j).any() else centres[j] for j in range(len(centres))])
        centres /= np.maximum(np.linalg.norm(centres, axis=1, keepdims=True), 1e-12)
    return centres.astype(np.float32)


def held_out(doc_id: Column, folds: int = 3, fold: int = 1) -> Column:
    """Whether the checksum of the id, as text, falls into the fold that is not learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % folds == fold, F.lit(False))


def fit(docs: DataFrame, learned: int = LEARNED, centroids: int = CENTROIDS) -> Model:
    """The model learned from rows of ``docs`` with a text, a ``lang`` and an id outside the held-out fold.

    At most ``learned`` documents per language are used, those with the least hash of the id, so the choice does
    not depend on their order or partition; of rows that repeat an id the least text counts. Without such rows the
    model knows no language.
    """
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    rows = rows.where("lang is not null and text is not null and doc_id is not null").where(~held_out(F.col("doc_id")))
    labels = rows.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(LABELS)
    # Three times as many as are wanted lie below this hash, so that the ranking gets a few rows however many there are.
    low = (F.xxhash64("doc_id").cast("double") / 2.0**64 + 0.5) * F.col("n") <= 3 * learned
    near = rows.select("lang", "doc_id").join(F.broadcast(labels), "lang").where(low).select("lang", "doc_id").distinct()
    order = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    chosen = near.withColumn("at", F.row_number().over(order)).where(F.col("at") <= learned).select("lang", "doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in text_groups(batches, "text", GROUP_BYTES):
            found = [counts(t) for t in group.column(2).to_pylist()]
            yield arrow_table({"doc_id": group.column(0), "lang": group.column(1),
                               "counts": [None if c is None else c.astype("<u4").tobytes() for c in found]}, LEARNING)

    # At most LABELS * learned rows by now.
    texts = rows.join(F.broadcast(chosen), ["lang", "doc_id"], "left_semi").groupBy("doc_id", "lang").agg(F.min("text").alias("text"))
    got = texts.mapInArrow(run, from_arrow_schema(LEARNING)).where("counts is not null").collect()
    got.sort(key=lambda r: (r["lang"], r["doc_id"], r["counts"]))
    if not got:
        return Model([], np.zeros((0, DIMENSIONS), np.float32), np.zeros(0), np.ones(DIMENSIONS, np.float32))
    matrix = np.stack([np.frombuffer(r["counts"], dtype="<u4") for r in got])
    idf = (np.log((1 + len(matrix)) / (1 + (matrix > 0).sum(axis=0))) + 1).astype(np.float32)
    vectors, labels = weighted(matrix, idf), np.array([r["lang"] for r in got])
    shares = attainable(matrix)
    langs, centres, floors = [], [], []
    for lang in sorted(set(labels.tolist())):
        own = vectors[labels == lang]
        found = clustered(own, centroids)
        langs += [lang] * len(found)
        centres += list(found)
        cosines = own @ found.T
        nearest, near = np.argmax(cosines, axis=1), np.max(cosines, axis=1) / shares[labels == lang]
        for j in range(len(found)):
            cluster = near[nearest == j]
            floors.append(MARGIN * float(np.quantile(cluster if len(cluster) >= ENOUGH else near, QUANTILE)))
    return Model(langs, np.stack(centres), np.array(floors), idf)


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score, rejected of every row; the prediction looks at ``text`` alone.

    The score is the cosine to the nearest centroid, from 0 to 1. A null text, one without a letter, and
    any text under a model without languages is ``und`` with score 0 and rejected. A rejected text
    otherwise keeps the name of the nearest language. Repeated rows give a row each.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in text_groups(batches, "text", GROUP_BYTES):
            found = model.predict(group.column(1).to_pylist())
            yield arrow_table({"doc_id": group.column(0), "lang_pred": [f[0] for f in found], "score": [f[1] for f in found], "rejected": [f[2] for f in found]}, PREDICTED)

    return docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).mapInArrow(run, from_arrow_schema(PREDICTED))


def accepted(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs``, with all columns, whose text is not rejected."""
    at, schema = docs.columns.index("text"), to_arrow_schema(docs.schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in text_groups(batches, "text", GROUP_BYTES):
            keep = pa.array([not rejected for _, _, rejected in model.predict(group.column(at).to_pylist())], type=pa.bool_())
            yield pa.RecordBatch.from_arrays([c.filter(keep) for c in group.columns], schema=schema)

    return docs.mapInArrow(run, docs.schema)
