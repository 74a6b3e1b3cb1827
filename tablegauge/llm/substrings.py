"""Removal of repeated passages by fixed-block anchors.

A passage of ``size`` words holds a whole block of ``size // 2`` words wherever it begins, if texts are cut into
blocks that do not overlap. These blocks are the index. Every rolling window of block length probes it;
where a block occurs at a second place, both are anchors. Hits are extended to all windows of ``size`` words around an
anchor. Equal windows meet by their hash, all but the earliest are repeats, and the union of the repeated windows
of a document gives its maximal repeats, which are removed.

Only hashes are shuffled, sorted and coded by chunk and bucket; the answers are one bit per hash. A passage that
stands in very many documents is one hash per chunk.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema

from tablegauge.llm.chunks import Words, bits, bucket_bits, chunked, coded, cut_at, decoded, steps, unbits, unpacked
from tablegauge.llm.common import arrow_table, staged

PROBE = pa.schema([("bucket", pa.int32()), ("chunk", pa.int64()), ("n", pa.int32()), ("keys", pa.binary()), ("block", pa.binary()), ("twice", pa.binary())])
WINDOW = pa.schema([("bucket", pa.int32()), ("chunk", pa.int64()), ("n", pa.int32()), ("keys", pa.binary()), ("base", pa.int64()), ("docs", pa.binary())])
ANSWER = pa.schema([("chunk", pa.int64()), ("step", pa.int32()), ("bucket", pa.int32()), ("flags", pa.binary())])
RESULT = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_text", pa.string()),
                    ("repeats", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))])


class Anchors:
    """The probes of a chunk: distinct block-length hashes, cut to ``32 + top`` bits, and where each occurs."""

    def __init__(self, words: Words, block: int, top: int):
        self.places = np.flatnonzero(words.whole(block))
        hashed = words.rolling(block)[self.places] >> np.uint64(32 - top)
        self.keys, self.inverse, counts = np.unique(hashed, return_inverse=True, return_counts=True)
        self.twice = counts > 1
        aligned = (self.places - words.first[words.doc[self.places]]) % block == 0
        self.block = np.zeros(len(self.keys), dtype=bool)
        self.block[self.inverse[aligned]] = True
        self.buckets = (self.keys >> np.uint64(32)).astype(np.int64)

    def hit(self, flags: dict[int, bytes], n_words: int) -> np.ndarray:
        """Whether an anchor begins at each word, by the answers for the buckets."""
        found = np.zeros(len(self.keys), dtype=bool)
        for bucket, a, b in cut_at(self.buckets):
            found[a:b] = unbits(flags[bucket], b - a)
        out = np.zeros(n_words, dtype=bool)
        out[self.places] = found[self.inverse]
        return out


class Windows:
    """The windows of a chunk that hold an anchor: distinct hashes, and the least id that has each."""

    def __init__(self, words: Words, ids: np.ndarray, anchors: np.ndarray, size: int, block: int, top: int):
        whole = words.whole(size)
        sums = np.concatenate([[0], np.cumsum(anchors)])
        n = len(whole)
        self.places = np.flatnonzero(whole & (sums[size - block + 1:size - block + 1 + n] > sums[:n]))
        hashed = words.rolling(size)[self.places]
        self.row = words.doc[self.places]
        self.ids = ids[self.row]
        order = np.lexsort((self.places, self.row, self.ids, hashed))
        ranked = hashed[order]
        new = np.concatenate([[True], ranked[1:] != ranked[:-1]]) if len(ranked) else np.zeros(0, dtype=bool)
        self.keys, self.least = ranked[new], self.ids[order][new]
        self.which = np.empty(len(order), dtype=np.int64)
        self.which[order] = np.cumsum(new) - 1
        # A window that stands earlier in its own text.
        rows = self.row[order]
        self.again = np.zeros(len(order), dtype=bool)
        self.again[order[1:]] = (ranked[1:] == ranked[:-1]) & (rows[1:] == rows[:-1])
        self.buckets = (self.keys >> np.uint64(64 - top)).astype(np.int64) if top else np.zeros(len(self.keys), dtype=np.int64)

    def repeated(self, flags: dict[int, bytes]) -> np.ndarray:
        """Places of windows whose words start earlier too: in an earlier document, or earlier in this one."""
        earlier = np.zeros(len(self.keys), dtype=bool)
        for bucket, a, b in cut_at(self.buckets):
            earlier[a:b] = unbits(flags[bucket], b - a)
        return self.places[earlier[self.which] | (self.ids > self.least[self.which]) | self.again]


def id_array(ids: list[int | None]) -> np.ndarray:
    """Ids for comparison; a null id comes before all others."""
    return np.array([np.iinfo(np.int64).min if i is None else i for i in ids], dtype=np.int64)


def remove_repeats(docs: DataFrame, size: int = 20) -> DataFrame:
    """doc_id, n_words, n_removed, kept_text, repeats (start, end as word numbers) of every row.

    ``docs`` needs ``doc_id`` and ``text``; other columns are not read. A word is removed if it lies in a window of
    ``size`` consecutive words that also starts earlier: in a document of smaller id, or earlier in the same
    one. A null text has no words. A null id comes before all others. Rows that share an id do not
    precede each other, so equal ones are judged alike. An empty table gives no rows.
    """
    block = size // 2
    if block < 1:
        raise ValueError("a window needs at least two words")
    chunks = chunked(docs, "chunks")
    top = min(20, bucket_bits(chunks))

    def probe(batches):
        for batch in batches:
            for chunk, payload in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                own = Anchors(Words(unpacked(payload)[1]), block, top)
                rows = [{"bucket": k, "chunk": chunk, "n": b - a,
                         "keys": coded(steps((own.keys[a:b] & np.uint64(0xFFFFFFFF)).astype("<u4"))),
                         "block": bits(own.block[a:b]), "twice": bits(own.twice[a:b])} for k, a, b in cut_at(own.buckets)]
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=PROBE)

    def anchor(key: tuple, group: pa.Table) -> pa.Table:
        rows = group.sort_by("chunk").to_pylist()
        keys = np.concatenate([np.cumsum(decoded(r["keys"], r["n"], "<u4"), dtype=np.uint32) for r in rows])
        _, inverse = np.unique(keys, return_inverse=True)
        places = np.bincount(inverse, weights=1 + np.concatenate([unbits(r["twice"], r["n"]) for r in rows]))
        blocks = np.bincount(inverse, weights=np.concatenate([unbits(r["block"], r["n"]) for r in rows]))
        return answers(key, rows, ((blocks > 0) & (places > 1))[inverse], 1)

    def answers(key: tuple, rows: list[dict], flags: np.ndarray, step: int) -> pa.Table:
        ends = np.cumsum([r["n"] for r in rows])
        return pa.Table.from_pydict({
            "chunk": [r["chunk"] for r in rows], "step": [step] * len(rows), "bucket": [key[0].as_py()] * len(rows),
            "flags": [bits(flags[e - r["n"]:e]) for e, r in zip(ends, rows)]}, schema=ANSWER)

    def opened(chunk: pa.Table, told: pa.Table) -> tuple:
        """Ids, words and windows of a chunk, and the answers of the second step."""
        ids, texts = unpacked(chunk.column("payload")[0].as_py())
        words, flags = Words(texts), ({}, {}, {})
        for r in told.to_pylist():
            flags[r["step"]][r["bucket"]] = r["flags"]
        anchors = Anchors(words, block, top).hit(flags[1], len(words.starts))
        return ids, words, Windows(words, id_array(ids), anchors, size, block, top), flags[2]

    def extend(key: tuple, chunk: pa.Table, told: pa.Table) -> pa.Table:
        if not chunk.num_rows:
            return WINDOW.empty_table()
        own, rows = opened(chunk, told)[2], []
        for k, a, b in cut_at(own.buckets):
            base = int(own.least[a:b].min())
            away = (own.least[a:b].astype(np.uint64) - np.uint64(base & (1 << 64) - 1)).astype("<u8")
            rows.append({"bucket": k, "chunk": key[0].as_py(), "n": b - a, "keys": coded(steps(own.keys[a:b].astype("<u8"))), "base": base, "docs": coded(away)})
        return pa.Table.from_pylist(rows, schema=WINDOW)

    def earliest(key: tuple, group: pa.Table) -> pa.Table:
        rows = group.sort_by("chunk").to_pylist()
        keys = np.concatenate([np.cumsum(decoded(r["keys"], r["n"], "<u8"), dtype=np.uint64) for r in rows])
        ids = np.concatenate([(decoded(r["docs"], r["n"], "<u8") + np.uint64(r["base"] & (1 << 64) - 1)).astype(np.int64) for r in rows])
        order = np.lexsort((ids, keys))
        ranked = keys[order]
        new = np.concatenate([[True], ranked[1:] != ranked[:-1]])
        least = ids[order][new][np.cumsum(new) - 1]
        flags = np.empty(len(order), dtype=bool)
        flags[order] = least < ids[order]
        return answers(key, rows, flags, 2)

    def remove(key: tuple, chunk: pa.Table, told: pa.Table) -> pa.Table:
        if not chunk.num_rows:
            return RESULT.empty_table()
        ids, words, windows, flags = opened(chunk, told)
        at = windows.repeated(flags)
        change = np.zeros(len(words.starts) + 1, dtype=np.int32)
        np.add.at(change, at, 1)
        np.add.at(change, at + size, -1)
        gone = np.cumsum(change[:-1]) > 0
        out = {"doc_id": ids, "n_words": np.diff(words.first).tolist(), "n_removed": [], "kept_text": [], "repeats": []}
        line, starts, ends = words.line, words.starts, words.ends
        for a, b in zip(words.first.tolist(), words.first[1:].tolist()):
            lost = gone[a:b]
            n = int(lost.sum())
            places = zip(starts[a:b][~lost].tolist(), ends[a:b][~lost].tolist()) if n else zip(starts[a:b].tolist(), ends[a:b].tolist())
            out["n_removed"].append(n)
            out["kept_text"].append(b" ".join([line[x:y] for x, y in places]).decode("utf-8", "surrogatepass"))
            turns = np.flatnonzero(np.diff(np.concatenate([[False], lost, [False]]).astype(np.int8))) if n else []
            out["repeats"].append([{"start": int(x), "end": int(y)} for x, y in zip(turns[::2], turns[1::2])])
        return pa.Table.from_batches([arrow_table(out, RESULT)])

    by_chunk = chunks.select("chunk", "payload").groupBy("chunk")
    probes = chunks.select("chunk", "payload").mapInArrow(probe, from_arrow_schema(PROBE))
    first = staged(probes.groupBy("bucket").applyInArrow(anchor, from_arrow_schema(ANSWER)), "anchors")
    tried = by_chunk.cogroup(first.groupBy("chunk")).applyInArrow(extend, from_arrow_schema(WINDOW))
    second = staged(tried.groupBy("bucket").applyInArrow(earliest, from_arrow_schema(ANSWER)), "earliest")
    return by_chunk.cogroup(first.unionByName(second).groupBy("chunk")).applyInArrow(remove, from_arrow_schema(RESULT))
