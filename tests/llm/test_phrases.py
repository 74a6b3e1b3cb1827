"""Phrase mining: all counts and scores against plain counting, and the index against plain search."""

import random
import re
from collections import Counter
from fractions import Fraction
from math import floor

import numpy as np
import pytest
from pyspark.sql import functions as F

from tablegauge.llm import phrases as P
from tests.llm.helpers import LOWER, documents, texts


def plain(rows, longest, least, ratio, top):
    """(lang, rank, phrase, a, l, r, n, score) by counting every phrase of every piece."""
    counts, totals, out = {}, Counter(), []
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            words = re.findall(r"[^\x20\x09]+", piece)
            totals[lang] += len(words)
            for k in range(1, longest + 1):
                counts.setdefault(lang, Counter()).update(tuple(words[i:i + k]) for i in range(len(words) - k + 1))
    for lang, f in counts.items():
        often = {w: a for w, a in f.items() if len(w) > 1 and a >= least}
        inside = {w[i:i + m] for w, a in often.items() for m in range(2, len(w)) for i in range(len(w) - m + 1) if a * 100 >= f[w[i:i + m]] * ratio}
        found = []
        for w in often.keys() - inside:
            score, k = min((floor(Fraction(1000 * f[w] * totals[lang], f[w[:k]] * f[w[k:]])), k) for k in range(1, len(w)))
            found.append((-score, -f[w], " ".join(w).encode(), f[w[:k]], f[w[k:]]))
        out += [(lang, i + 1, p.decode(), -a, x, y, totals[lang], -s) for i, (s, a, p, x, y) in enumerate(sorted(found)[:top])]
    return sorted(out)


def mined(docs, *args):
    return sorted(tuple(r)[:8] for r in P.mine_phrases(docs, *args).collect())


def sample():
    own = random.Random(5)
    rows = [(("en", "fr", None, "und")[i % 4] if own.random() < 0.6 else "en", t) for i, (_, t) in enumerate(texts())]
    few = ["the", "of", "a", "new", "york", "city", "x.y", "don't", "é", "I"]
    rows += [("en", "".join(own.choice(few) + own.choice([" ", " ", "  ", "\t", ". ", ", ", "\n"]) for _ in range(300))) for _ in range(20)]
    return rows + [("", "one two one two one two"), ("en", "a " * 500 + ". . ,;"), ("en", "in New York City! in new york city")] * 3


@pytest.mark.parametrize("longest,least,ratio,top", [(5, 3, 100, 2_000), (4, 2, 60, 40), (2, 5, 100, 7)])
@pytest.mark.parametrize("sizes", [(16 << 20, 1_000_000, 100_000), (2_000, 500, 30)])
def test_all_counts_and_scores(spark, monkeypatch, longest, least, ratio, top, sizes):
    if sizes[2] < top and top > 100:
        sizes = (*sizes[:2], 100_000)
    for name, size in zip(("SHARD_BYTES", "BUCKET_WORDS", "RANKED_AT_ONCE"), sizes):
        monkeypatch.setattr(P, name, size)
    rows = sample()
    docs = documents(spark, [(i, t) for i, (_, t) in enumerate(rows)]).join(
        spark.createDataFrame([(i, lang) for i, (lang, _) in enumerate(rows)], "doc_id bigint, own string"), "doc_id")
    assert mined(docs.withColumn("lang", F.col("own")).drop("own"), longest, least, ratio, top) == plain(rows, longest, least, ratio, top)


def test_rounds_of_bounded_groups(spark, monkeypatch):
    monkeypatch.setattr(P, "RANKED_AT_ONCE", 20)
    rows = sample()
    docs = spark.createDataFrame(rows, "lang string, text string").repartition(4)
    assert mined(docs, 4, 2, 100, 8) == plain(rows, 4, 2, 100, 8)


def test_empty_tables_and_texts(spark):
    docs = documents(spark, [(1, None), (2, ""), (3, " .,; \n")])
    assert P.mine_phrases(docs).collect() == [] and P.mine_phrases(docs.limit(0)).collect() == []


def test_products_beyond_64_bits(spark):
    counts = spark.createDataFrame([("en", "a", 1, 9 * 10**12), ("en", "b", 1, 8 * 10**12), ("en", "a b", 2, 7 * 10**12)], "lang string, phrase string, length int, a bigint")
    totals = spark.createDataFrame([("en", 10**17)], "lang string, n bigint")
    assert P.scored(counts, totals, 100).first().score == 1000 * 7 * 10**12 * 10**17 // (72 * 10**24)


def test_intervals_are_the_places_of_a_phrase():
    own = random.Random(1)
    words = [own.choice("abcd") for _ in range(400)]
    row = P.shard_row(0, ["en"], [" ".join(w + own.choice(["", "", "."]) for w in words).encode()], 5)
    shard = P.Shard(row)
    line = np.zeros(row["n"], dtype=np.int32)
    levels = shard.levels([], [range(1, 6)], 1)
    for p in levels:
        assert len({tuple(w) for w in p.words.tolist()}) == len(p.words)
        assert len(set(p.hashes.tolist())) == len(p.words)
        # Intervals of equally long phrases do not overlap, in either transform.
        for at in (p.first, p.last):
            order = np.argsort(at)
            assert ((at + p.count)[order][:-1] <= at[order][1:]).all() and (at + p.count).max() <= len(line)
