"""Documents in chunks, and the hashes of their words, for operators that compare all words of a corpus.

A chunk is a run of documents of some megabytes, kept in one row and compressed. What an operator has to
compare across chunks it sends as sorted, coded arrays, one per chunk and bucket of the hash; the answer for a
chunk is an array of the same order, so that neither hashes nor places have to travel back.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema

from tablegauge.llm.common import arrow_table, staged, text_groups

#: Bytes of text in a chunk; a longer document is a chunk of its own.
CHUNK_BYTES = 4 << 20
#: Bytes whose words are hashed at a time.
HASH_BYTES = 1 << 19
#: Entries that one bucket of hashes holds, about.
BUCKET_ENTRIES = 2_000_000
#: Bytes of a text per word, about; only the number of buckets depends on it.
WORD_BYTES = 6

CHUNK = pa.schema([("chunk", pa.int64()), ("bytes", pa.int64()), ("payload", pa.binary())])
ROWS = pa.schema([("doc_id", pa.int64()), ("text", pa.string())])


def chunked(docs: DataFrame, name: str, size: int = CHUNK_BYTES) -> DataFrame:
    """(chunk, bytes, payload): all rows of ``docs`` (doc_id, text) in chunks, written to the shared folder."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = TaskContext.get().partitionId() << 32
        for i, group in enumerate(text_groups(batches, "text", size)):
            sink = pa.BufferOutputStream()
            rows = pa.RecordBatch.from_arrays([group.column(0).cast(pa.int64()), group.column(1).cast(pa.string())], schema=ROWS)
            with pa.ipc.new_stream(sink, ROWS, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", 3))) as out:
                out.write_batch(rows)
            yield arrow_table({"chunk": [first + i], "bytes": [rows.nbytes], "payload": [sink.getvalue().to_pybytes()]}, CHUNK)

    columns = (F.col("doc_id").cast("bigint"), F.col("text").cast("string"))
    return staged(docs.select(*columns).mapInArrow(run, from_arrow_schema(CHUNK)), name)


def unpacked(payload: bytes) -> tuple[list[int | None], list[bytes]]:
    """Ids and UTF-8 texts of a chunk; a null text is empty."""
    rows = pa.ipc.open_stream(payload).read_all()
    return rows.column(0).to_pylist(), [t or b"" for t in rows.column(1).cast(pa.binary()).to_pylist()]


def bucket_bits(chunks: DataFrame) -> int:
    """Bits of the hash that number the buckets, so that each gets about ``BUCKET_ENTRIES`` words."""
    total = chunks.agg(F.sum("bytes")).first()[0] or 0
    return max(0, math.ceil(math.log2(max(1.0, total / (WORD_BYTES * BUCKET_ENTRIES)))))


def mixed(x: np.ndarray) -> np.ndarray:
    """The bits of 64-bit numbers, each spread over the whole number; one-to-one."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


BASES = {"letters": 0x9E3779B97F4A7C15 | 1, "words": 0xD1342543DE82EF95 | 1}
LETTER = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
GAP = np.zeros(256, dtype=bool)
GAP[[0x20, *range(0x09, 0x0E)]] = True


@lru_cache(maxsize=8)
def _powers(base: str, inverse: bool, size: int) -> np.ndarray:
    factor = pow(BASES[base], -1, 1 << 64) if inverse else BASES[base]
    out = np.full(size, factor, dtype=np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def powers(base: str, inverse: bool, n: int) -> np.ndarray:
    """The first ``n`` powers of an odd number, or of its inverse, modulo 2^64."""
    return _powers(base, inverse, max(1 << 16, 1 << (max(1, n) - 1).bit_length()))[:n]


class Words:
    """The words of some texts: places in ``line``, hashes, and the text each belongs to."""

    def __init__(self, texts: list[bytes]):
        self.line = b"\n".join([*texts, b""])
        octets = np.frombuffer(self.line, dtype=np.uint8)
        gap = GAP[octets]
        edges = np.flatnonzero(gap[1:] != gap[:-1]) + 1
        if len(gap) and not gap[0]:
            edges = np.concatenate([[0], edges])
        self.starts, self.ends = edges[::2], edges[1::2]
        begins = np.cumsum([0, *(len(t) + 1 for t in texts)])
        self.first = np.searchsorted(self.starts, begins)  # of each text, and one more
        self.doc = np.repeat(np.arange(len(texts)), np.diff(self.first))
        self.hashes = self._hashes(octets)

    def _hashes(self, octets: np.ndarray) -> np.ndarray:
        out, i, n = np.empty(len(self.starts), dtype=np.uint64), 0, len(self.starts)
        while i < n:
            base = self.starts[i]
            j = max(i + 1, int(np.searchsorted(self.ends, base + HASH_BYTES, side="right")))
            a, b = self.starts[i:j] - base, self.ends[i:j] - base
            part = LETTER[octets[base:self.ends[j - 1]]]
            sums = np.zeros(len(part) + 1, dtype=np.uint64)
            np.cumsum(part * powers("letters", False, len(part)), out=sums[1:])
            raw = (sums[b] - sums[a]) * powers("letters", True, len(part))[a]
            out[i:j] = mixed(raw + (b - a).astype(np.uint64))
            i = j
        return out

    def rolling(self, size: int) -> np.ndarray:
        """A hash of the ``size`` words from each place on, for all places but the last ``size - 1``."""
        n = len(self.hashes)
        if n < size:
            return np.empty(0, dtype=np.uint64)
        sums = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(self.hashes * powers("words", False, n), out=sums[1:])
        return mixed((sums[size:] - sums[:-size]) * powers("words", True, n)[:n - size + 1])

    def whole(self, size: int) -> np.ndarray:
        """Whether the ``size`` words from each place on belong to one text."""
        return self.doc[size - 1:] == self.doc[:len(self.doc) - size + 1] if len(self.doc) >= size else np.zeros(0, dtype=bool)


def coded(values: np.ndarray) -> bytes:
    """Ascending or small unsigned numbers, byte by byte of equal weight, compressed."""
    planes = np.ascontiguousarray(values).view(np.uint8).reshape(len(values), values.itemsize).T
    return pa.compress(np.ascontiguousarray(planes).tobytes(), codec="zstd", asbytes=True)


def decoded(blob: bytes, n: int, kind: str) -> np.ndarray:
    width = np.dtype(kind).itemsize
    octets = np.frombuffer(pa.decompress(blob, decompressed_size=n * width, codec="zstd", asbytes=True), dtype=np.uint8)
    return np.ascontiguousarray(octets.reshape(width, n).T).view(kind).reshape(n)


def steps(values: np.ndarray) -> np.ndarray:
    """Differences of ascending numbers, the first from zero."""
    return np.diff(values, prepend=values.dtype.type(0))


def bits(flags: np.ndarray) -> bytes:
    return np.packbits(flags).tobytes()


def unbits(blob: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(blob, dtype=np.uint8), count=n).astype(bool)


def cut_at(numbers: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(number, first, one past the last) of each run of equal numbers."""
    if len(numbers):
        first = np.flatnonzero(np.concatenate([[True], numbers[1:] != numbers[:-1]]))
        for a, b in zip(first.tolist(), [*first[1:].tolist(), len(numbers)]):
            yield int(numbers[a]), a, b
