"""Near-duplicates against brute force over all pairs."""

import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tablegauge.llm.components import components
from tablegauge.llm.simhash import links, near_duplicates
from tablegauge.llm.common import joined_by_key
from tests.llm.helpers import LOWER, WORD, documents, prose, texts


def fingerprint(text):
    words = WORD.findall((text or "").translate(LOWER))
    shingles = [" ".join(words[i:i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def least_reachable(nodes, pairs):
    """Component of each node by its least member."""
    own = {n: n for n in nodes}

    def find(x):
        while own[x] != x:
            x = own[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        if a != b:
            own[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_documents(spark):
    base = prose(50, 400)
    docs = [(i, t) for i, t in texts() if i is not None and i != 7]
    docs += [(200 + i, base + f" extra{i}") for i in range(40)] + [(300, base), (301, base)]
    prints = {i: fingerprint(t) for i, t in docs}
    ids = list(prints)
    pairs = [(a, b) for n, a in enumerate(ids) for b in ids[n + 1:] if (prints[a] ^ prints[b]).bit_count() <= 3]
    expected = least_reachable(ids, pairs)
    got = near_duplicates(documents(spark, docs)).collect()
    assert {(r.doc_id, r.fingerprint, r.component_id) for r in got} == {(i, f"{prints[i]:016x}", expected[i]) for i in ids}
    assert len(got) == len(docs)


def test_odd_rows(spark):
    docs = [(5, None), (3, ""), (9, " \n"), (4, "one"), (4, "one"), (None, "one"), (None, "alone here now"), (8, "one two")]
    got = sorted(((r.doc_id, r.component_id) for r in near_duplicates(documents(spark, docs)).collect()), key=str)
    assert got == sorted([(5, 3), (3, 3), (9, 3), (4, 4), (4, 4), (None, 4), (None, None), (8, 8)], key=str)
    assert near_duplicates(documents(spark, [])).collect() == []


@pytest.mark.parametrize("distance", [1, 3, 7])
def test_links_are_complete(spark, distance):
    own = random.Random(distance)
    prints = {own.getrandbits(64) for _ in range(150)}
    for p in list(prints)[:60]:
        for _ in range(6):
            q = p
            for _ in range(own.randrange(distance + 3)):
                q ^= 1 << own.randrange(64)
            prints.add(q)
    prints |= {0, 2**64 - 1, 2**63, 1}
    signed = [p - 2**64 if p >= 2**63 else p for p in sorted(prints)]
    got = {(r.a, r.b) for r in links(spark.createDataFrame([(s,) for s in signed], "bits bigint"), distance).collect()}
    array = np.array(signed, dtype=np.int64).view(np.uint64)
    expected = {(min(signed[i], signed[j]), max(signed[i], signed[j])) for i in range(len(signed)) for j in range(i)
                if int(array[i] ^ array[j]).bit_count() <= distance}
    assert got == expected


def test_components(spark):
    own = random.Random(1)
    nodes = list(range(400))
    pairs = [(own.choice(nodes), own.choice(nodes)) for _ in range(260)] + [(1000 + i, 1001 + i) for i in range(300)] + [(5000, 6000 + i) for i in range(200)]
    frame = spark.createDataFrame([*pairs, *pairs[:20], (3, 3), (None, 4)], "a bigint, b bigint").repartition(5)
    got = {r.node: r.component for r in components(frame).collect()}
    linked = {x for p in pairs if p[0] != p[1] for x in p}
    expected = least_reachable(linked, pairs)
    assert got == expected
    assert components(frame.limit(0)).collect() == [] and components(frame.select(F.col("a"), F.col("a").alias("b"))).collect() == []


def test_sides_that_look_small_are_not_broadcast(spark):
    """A fingerprint has some 40 rows in the join of the segments, and Spark takes them for the size of the fingerprint."""
    def plan(df):
        return df._jdf.queryExecution().executedPlan().toString()

    prints = spark.range(50).selectExpr("xxhash64(id) as bits")
    found = plan(links(prints))
    assert "SortMergeJoin" in found and "BroadcastExchange" not in found
    looked_up = spark.range(5).selectExpr("id as key", "id * 2 as other", "id % 3 as n")
    rows = spark.range(50).selectExpr("id % 5 as key")
    again = joined_by_key(rows, looked_up, "key", "n", 200)
    assert plan(again).count("SortMergeJoin") == 1 and again.count() == 50
