"""Removal of repeated passages against a brute-force version."""

import pytest

from tablegauge.llm.substrings import remove_repeats
from tests.llm.helpers import WORD, documents, prose, texts


def brute(docs, size):
    """Rows by id and text; a window is repeated if a smaller id, or the same text earlier, has it."""
    starts = {}
    split = [(i, WORD.findall(t or "")) for i, t in docs]
    rank = lambda i: (i is not None, i or 0)
    for i, w in split:
        for s in range(len(w) - size + 1):
            starts.setdefault(tuple(w[s:s + size]), set()).add(rank(i))
    out = []
    for i, w in split:
        gone, seen = [False] * len(w), set()
        for s in range(len(w) - size + 1):
            key = tuple(w[s:s + size])
            if min(starts[key]) < rank(i) or key in seen:
                gone[s:s + size] = [True] * size
            seen.add(key)
        out.append((i, len(w), sum(gone), " ".join(x for x, g in zip(w, gone) if not g)))
    return sorted(out, key=str)


@pytest.mark.parametrize("size", [20, 7, 2])
def test_brute_force(spark, size):
    docs = texts()
    rows = remove_repeats(documents(spark, docs), size).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_text) for r in rows), key=str) == brute(docs, size)
    for r in rows:
        assert sum(x.end - x.start for x in r.repeats) == r.n_removed


def test_many_chunks_and_buckets(spark, monkeypatch):
    from tablegauge.llm import substrings

    monkeypatch.setattr(substrings, "bucket_bits", lambda chunks: 5)
    monkeypatch.setattr(substrings, "chunked", lambda docs, name, real=substrings.chunked: real(docs, name, 2_000))
    docs = texts(80)
    rows = remove_repeats(documents(spark, docs)).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_text) for r in rows), key=str) == brute(docs, 20)


def test_no_rows(spark):
    assert remove_repeats(documents(spark, [])).collect() == []
    assert remove_repeats(documents(spark, [(1, None), (2, "")])).count() == 2


def test_passage_at_every_shift(spark):
    passage = prose(77, 20)
    docs = [(i, f"{prose(1000 + i, i)} {passage} {prose(2000 + i, 9)}") for i in range(25)]
    got = {r.doc_id: r.n_removed for r in remove_repeats(documents(spark, docs)).collect()}
    assert got == {i: n for i, _, n, _ in brute(docs, 20)}
    assert got[0] == 0 and all(got[i] >= 20 for i in range(1, 25))
