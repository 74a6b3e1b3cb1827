"""Near-duplicate documents by SimHash, with candidates pruned by the pigeonring principle.

Two fingerprints that differ in at most ``t`` bits are cut into a ring of ``t + 1`` segments. Some segment then
starts a chain whose first ``l`` segments differ in at most ``l * t / (t + 1)`` bits for every ``l``: the
first not at all, the first two in one bit at most, and so on. The index holds each segment with the one
after it; a probe asks for the pair itself and for the pairs with one bit of the second segment cleared, so
that the join itself yields chains of two. Longer chains and the whole distance are checked on the joined
rows. Equal fingerprints meet only once, as one node, which has at most C(64,1)+C(64,2)+C(64,3) neighbours.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema

from tablegauge.llm.common import arrow_table, joined_by_key, staged, text_groups
from tablegauge.llm.components import components

GROUP_BYTES = 4 << 20
LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
PRINT = pa.schema([("doc_id", pa.int64()), ("bits", pa.int64())])
#: Shingles whose bits are counted at a time.
BLOCK = 1 << 16


def shingle_hashes(text: str, size: int, seed: int) -> np.ndarray:
    """XXH64 of the shingles of the text; one of all words where they are fewer than ``size``."""
    import xxhash

    words = text.encode("utf-8", "surrogatepass").translate(LOWER).split()
    if not words:
        return np.empty(0, dtype="<u8")
    line, hashed = b" ".join(words), xxhash.xxh64_intdigest
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1) - 1
    starts = [0, *(ends[:-1] + 1).tolist()]
    ends = ends[size - 1:].tolist() or [len(line)]
    return np.array([hashed(line[a:b], seed) for a, b in zip(starts, ends)], dtype="<u8")


def fingerprint(hashes: np.ndarray) -> int:
    """The bits that are set in over half of the hashes, as a signed long; zero for none."""
    counts = np.zeros(64, dtype=np.int64)
    for i in range(0, len(hashes), BLOCK):
        octets = hashes[i:i + BLOCK].view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(octets, axis=1, bitorder="little").sum(axis=0, dtype=np.uint32)
    bits = np.packbits(2 * counts > len(hashes), bitorder="little")
    return int(bits.view("<i8")[0])


def fingerprints(docs: DataFrame, size: int = 3, seed: int = 42) -> DataFrame:
    """(doc_id, bits) of every row; a null text has no words, and no words give zero bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in text_groups(batches, "text", GROUP_BYTES):
            bits = [fingerprint(shingle_hashes(t or "", size, seed)) for t in group.column(1).to_pylist()]
            yield arrow_table({"doc_id": group.column(0), "bits": bits}, PRINT)

    return docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).mapInArrow(run, from_arrow_schema(PRINT))


def links(prints: DataFrame, distance: int = 3) -> DataFrame:
    """(a, b), a < b: all pairs of the distinct fingerprints ``bits`` that differ in at most ``distance`` bits."""
    ring = distance + 1
    if 64 % ring or ring < 2:
        raise ValueError("distance + 1 must divide 64 and be at least 2")
    width = 64 // ring
    turned = F.explode(F.array(*[
        F.struct(F.lit(i).alias("at"), (F.shiftleft("bits", i * width).bitwiseOR(F.shiftrightunsigned("bits", 64 - i * width)) if i else F.col("bits")).alias("own"))
        for i in range(ring)]))
    rows = prints.select("bits", turned.alias("t")).select(
        "bits", "t.at", F.col("t.own").alias("turn"), F.shiftrightunsigned("t.own", 64 - width).alias("first"),
        F.shiftrightunsigned("t.own", 64 - 2 * width).bitwiseAND(F.lit((1 << width) - 1)).alias("second"))
    masks = F.array(*[F.lit(~(1 << b) & (1 << width) - 1).cast("bigint") for b in range(width)])
    cleared = F.filter(F.transform(masks, lambda m: F.col("second").bitwiseAND(m)), lambda x: x != F.col("second"))
    asked = rows.select("at", "first", F.explode(F.concat(F.array("second"), cleared)).alias("second"),
                        F.col("second").alias("had"), F.col("bits").alias("p"), F.col("turn").alias("p_turn"))
    # Spark takes each side for as large as the fingerprints, though it has many rows for each of them: never broadcast one.
    met = rows.join(asked.hint("merge"), ["at", "first", "second"])
    apart = F.col("turn").bitwiseXOR(F.col("p_turn"))
    # The pair that agrees in the second segment meets both ways, the one that differs there only one way.
    chain = (F.col("second") != F.col("had")) | (F.col("bits") < F.col("p"))
    for n in range(3, ring + 1):
        ahead = apart if n == ring else F.shiftrightunsigned(apart, 64 - n * width)
        chain &= F.bit_count(ahead) <= n - 1
    if ring == 2:
        chain &= F.bit_count(apart) <= distance
    return met.where(chain).select(F.least("bits", "p").alias("a"), F.greatest("bits", "p").alias("b")).where("a <> b").distinct()


def near_duplicates(docs: DataFrame, distance: int = 3, size: int = 3, seed: int = 42) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id: the smallest doc_id reachable over links.

    ``docs`` needs ``doc_id`` and ``text``; other columns are not read. Every row gives one row, repeated ones
    too. A text without words, null included, has fingerprint zero and links like any other. A null id is
    never the smallest; a component of null ids alone has a null component_id. No rows give none.
    """
    prints = staged(fingerprints(docs, size, seed), "fingerprints")
    total = prints.count()
    nodes = staged(prints.groupBy("bits").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")), "nodes")
    tied = staged(components(links(nodes.select("bits"), distance)).withColumnRenamed("node", "bits"), "components")
    # Only fingerprints with a link need the least id of others.
    inside = nodes.join(tied.hint("merge"), "bits")
    least = inside.groupBy("component").agg(F.min("least").alias("component_id"), F.count("*").alias("n"))
    known = joined_by_key(tied, least, "component", "n", max(1, tied.count())).select("bits", F.col("component_id").alias("linked_id"), F.lit(True).alias("linked"))
    owner = staged(nodes.join(known.hint("merge"), "bits", "left").select(
        "bits", "n", F.when(F.col("linked"), F.col("linked_id")).otherwise(F.col("least")).alias("component_id")), "owners")
    return joined_by_key(prints, owner, "bits", "n", total).select(
        "doc_id", F.lpad(F.lower(F.hex("bits")), 16, "0").alias("fingerprint"), "component_id")
