"""Best-fit packing of documents into token sequences, by hierarchical residual packing.

Each partition tokenizes its documents and packs the pieces by best fit, largest first. Bins that are
full but for a few tokens are sealed. The others, each taken as one item as large as its fill, meet
those of other partitions in the nodes of the next level of a tree, where best fit runs again, and so
on up to the root. Only unsealed bins are shuffled, and a node holds a bounded number of them.
"""

from __future__ import annotations

import json
import math
import zlib
from collections.abc import Iterable, Iterator
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema

from tablegauge.llm.common import staged, text_groups

#: Texts are tokenized in groups of this many bytes.
GROUP_BYTES = 4 << 20
#: Pieces that a partition, and bins that a node of the tree, packs at a time.
NODE_ITEMS = 20_000
#: A bin with at most this many free tokens is nearly full and is sealed.
SLACK = 2

PIECE = pa.struct([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("offset", pa.int64())])
BIN = pa.schema([("level", pa.int32()), ("node", pa.int64()), ("number", pa.int64()), ("fill", pa.int32()), ("sealed", pa.bool_()), ("pieces", pa.list_(PIECE))])


class Ids:
    """Token ids of whole texts by the vocabulary of a tokenizer file with byte-level BPE.

    The ids are those of ``tokenizers`` with ``add_special_tokens=False``; ``tiktoken`` computes them from
    the same vocabulary at a fraction of the time. Texts that spell a special token, and any that
    ``tiktoken`` refuses, go to ``tokenizers`` itself.
    """

    def __init__(self, path: str):
        import tiktoken

        with open(path, encoding="utf-8") as file:
            described = json.load(file)
        self.special = [a["content"] for a in described["added_tokens"]]
        named = {a["id"] for a in described["added_tokens"]}
        byte_of = {c: b for b, c in byte_letters().items()}
        ranks = {bytes(byte_of[c] for c in token): i for token, i in described["model"]["vocab"].items() if i not in named}
        # The split that the file names: contractions, letters, digits, other signs, white space.
        pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
        self.fast = tiktoken.Encoding(path, pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.path = path

    @cached_property
    def exact(self):
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path)

    def __call__(self, text: str) -> list[int]:
        if not any(s in text for s in self.special):
            try:
                return self.fast.encode_ordinary(text)
            except BaseException as refused:  # the library's own panic is no Exception
                if isinstance(refused, KeyboardInterrupt | SystemExit):
                    raise
        return self.exact.encode(text, add_special_tokens=False).ids


def byte_letters() -> dict[int, str]:
    """The printable letter that byte-level BPE writes for each byte: itself, or one from 256 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    other = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(other)}


@lru_cache(maxsize=4)
def ids_of(path: str) -> Ids:
    return Ids(path)


def best_fit(sizes: Iterable[int], limit: int) -> list[list[int]]:
    """Places of the sizes in bins of ``limit``, each in the open bin that it fills best; largest first.

    Bit ``r`` of ``free`` tells that a bin with ``r`` free tokens is open, so the best one is the lowest
    bit from the size on.
    """
    sizes = np.asarray(sizes)
    bins: list[list[int]] = []
    by_free: list[list[list[int]]] = [[] for _ in range(limit + 1)]
    free = 0
    for i in np.argsort(-sizes, kind="stable").tolist():
        size = int(sizes[i])
        if fits := free >> size:
            room = size + (fits & -fits).bit_length() - 1
            chosen = by_free[room].pop()
            if not by_free[room]:
                free &= ~(1 << room)
        else:
            room, chosen = limit, []
            bins.append(chosen)
        chosen.append(i)
        if room > size:
            by_free[room - size].append(chosen)
            free |= 1 << (room - size)
    return bins


def packed(items: list[tuple[int, list[dict]]], limit: int, slack: int, level: int, node: int, first: int) -> pa.RecordBatch:
    """Rows of bins made of the items (size, pieces); the pieces' offsets move along with their item."""
    rows = []
    for number, places in enumerate(best_fit([size for size, _ in items], limit), first):
        fill, pieces = 0, []
        for i in places:
            size, own = items[i]
            pieces += [p | {"offset": p["offset"] + fill} for p in own]
            fill += size
        rows.append({"level": level, "node": node, "number": number, "fill": fill, "sealed": limit - fill <= slack, "pieces": pieces})
    return pa.RecordBatch.from_pylist(rows, schema=BIN)


def cut(doc_id: int | None, ids: list[int], limit: int) -> Iterator[tuple[int, list[dict]]]:
    """The pieces of a document; where it is longer than a sequence, the first takes what is over."""
    whole = np.asarray(ids, dtype="<u4")
    bounds = [0, *range(len(whole) % limit or limit, len(whole) + 1, limit)] if len(whole) > limit else [0, len(whole)]
    for piece, (start, end) in enumerate(zip(bounds, bounds[1:])):
        crc = zlib.crc32(whole[start:end].tobytes())
        yield end - start, [{"doc_id": doc_id, "piece": piece, "start": start, "length": end - start, "ids_crc32": crc, "offset": 0}]


def pack(docs: DataFrame, tokenizer: str, limit: int = 1024, end_id: int = 2, slack: int = SLACK, node_items: int = NODE_ITEMS) -> DataFrame:
    """One row per piece of a document: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    ``docs`` needs ``doc_id`` and ``text``; other columns are not read. A null or empty text is the end token
    alone. Rows that repeat an id are packed each for itself; a null id stays null. An empty table gives no
    rows. A document longer than ``limit`` gives full pieces after a first one with the rest.
    """

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, node = ids_of(tokenizer), TaskContext.get().partitionId()
        items: list[tuple[int, list[dict]]] = []
        made = 0
        for group in text_groups(batches, "text", GROUP_BYTES):
            for doc_id, text in zip(group.column(0).to_pylist(), group.column(1).to_pylist()):
                items.extend(cut(doc_id, [*encode(text or ""), end_id], limit))
                if len(items) >= node_items:
                    out = packed(items, limit, slack, 0, node, made)
                    made, items = made + out.num_rows, []
                    yield out
        if items:
            yield packed(items, limit, slack, 0, node, made)

    def merge(level: int):
        def run(key: tuple, group: pa.Table) -> pa.Table:
            rows = group.sort_by([("level", "ascending"), ("node", "ascending"), ("number", "ascending")]).select(["fill", "pieces"]).to_pylist()
            out = packed([(r["fill"], r["pieces"]) for r in rows], limit, slack, level, key[0].as_py(), 0)
            return pa.Table.from_batches([out])

        return run

    bins = staged(docs.select("doc_id", "text").mapInArrow(local, from_arrow_schema(BIN)), "pack-0")
    done, left, count, level = [], bins.where("sealed = false"), None, 0
    done.append(bins.where("sealed"))
    while True:
        now = left.count()
        nodes = math.ceil(now / node_items)
        # Done at the root, or where a level no longer joins bins: then none of them fit together.
        if now <= 1 or level and (last_nodes == 1 or now > 0.99 * count):
            break
        count, last_nodes, level = now, nodes, level + 1
        placed = left.withColumn("to", F.pmod(F.xxhash64("level", "node", "number"), F.lit(nodes)))
        bins = staged(placed.groupBy("to").applyInArrow(merge(level), from_arrow_schema(BIN)), f"pack-{level}")
        done.append(bins.where("sealed"))
        left = bins.where("sealed = false")
    everything = left
    for part in done:
        everything = everything.unionByName(part)
    sequence = F.shiftleft(F.col("level").cast("bigint"), 58) + F.shiftleft("node", 32) + F.col("number")
    return everything.select(sequence.alias("sequence_id"), F.explode("pieces").alias("p")).select(
        "p.doc_id", "p.piece", "p.start", "p.length", "p.ids_crc32", "sequence_id", "p.offset")
