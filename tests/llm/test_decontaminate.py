"""Decontamination against a brute-force version."""

import hashlib
import re

import pytest

from tablegauge.llm import decontaminate as D
from tests.llm.helpers import CLASHES, LOWER, documents, prose, texts

WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def items_frame(spark, items):
    schema = "item_id bigint, text string, " + ", ".join(f"`{c}` string" for c in CLASHES)
    return spark.createDataFrame([(*r, *["y"] * len(CLASHES)) for r in items], schema)


def brute(docs, items, size=10):
    windows = {}
    for item, text in items:
        w = WORDS.findall((text or "").translate(LOWER))
        n = min(size, len(w))
        for s in range(len(w) - n + 1 if n else 0):
            windows.setdefault(tuple(w[s:s + n]), set()).add(item)
    out = []
    for i, text in docs:
        w = WORDS.findall((text or "").translate(LOWER))
        hit, found = set(), set()
        for n in {len(x) for x in windows}:
            for s in range(len(w) - n + 1):
                if tuple(w[s:s + n]) in windows:
                    hit.update(range(s, s + n))
                    found |= windows[tuple(w[s:s + n])]
        names = sorted(str(x) for x in found if x is not None)
        out.append((i, len(w), len(hit), len(names), hashlib.sha256(",".join(names).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


@pytest.mark.parametrize(("size", "k", "block"), [(10, 5, 200_000), (10, 5, 30), (4, 2, 200_000)])
def test_brute_force(spark, monkeypatch, size, k, block):
    monkeypatch.setattr(D, "BLOCK_WINDOWS", block)
    docs = [*texts(40), (700, "Alpha, beta; GAMMA-delta! épsilon 漢字 " * 4), (701, "one two three four"), (702, "a " * 3000)]
    items = [(1, prose(999, 45)[40:160]), (2, "alpha beta gamma delta épsilon 漢字 alpha beta gamma delta"), (3, "TWO three"), (4, None), (5, "..."),
             (6, "a a a a a a a a a a a"), (7, prose(999, 45)), (None, "one two three four"), (8, "two three"), (9, "w1")]
    rows = D.decontaminate(documents(spark, docs), items_frame(spark, items), size, k).drop("text_xxhash64").collect()
    assert sorted(map(tuple, rows), key=str) == brute(docs, items, size)


def test_empty_tables(spark):
    assert D.decontaminate(documents(spark, []), items_frame(spark, [(1, "a b c")])).collect() == []
    rows = D.decontaminate(documents(spark, [(1, "a b c"), (2, None)]), items_frame(spark, [])).collect()
    assert {(r.doc_id, r.n_words, r.n_hit, r.contaminated) for r in rows} == {(1, 3, 0, False), (2, 0, 0, False)}


def test_plan_is_native(spark):
    docs = documents(spark, [(1, "a b c")])
    plan = D.decontaminate(docs, items_frame(spark, [(1, "a b c")]))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan.replace("LocalRelation", ""))
