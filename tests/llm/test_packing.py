"""Packing: pieces round-trip to the token ids, sequences are gapless, full and few."""

import zlib
from collections import defaultdict

import numpy as np
from tokenizers import Tokenizer

from tablegauge.llm.packing import best_fit, ids_of, pack
from tablegauge.llm.packing_query import tokenizer_file
from tests.llm.helpers import documents, texts


def check(rows, docs, limit):
    exact = Tokenizer.from_file(tokenizer_file())
    expected = defaultdict(int)
    for doc_id, text in docs:
        ids = np.array([*exact.encode(text or "", add_special_tokens=False).ids, 2], dtype="<u4")
        first = len(ids) % limit or limit
        bounds = [0, *range(first, len(ids) + 1, limit)] if len(ids) > limit else [0, len(ids)]
        for piece, (a, b) in enumerate(zip(bounds, bounds[1:])):
            expected[doc_id, piece, a, b - a, zlib.crc32(ids[a:b].tobytes())] += 1
    got, sequences = defaultdict(int), defaultdict(list)
    for r in rows:
        got[r.doc_id, r.piece, r.start, r.length, r.ids_crc32] += 1
        sequences[r.sequence_id].append((r.offset, r.length))
    assert got == expected
    for pieces in sequences.values():
        end = 0
        for offset, length in sorted(pieces):
            assert offset == end
            end += length
        assert end <= limit
    return len(sequences), sum(r.length for r in rows)


def test_pieces_and_sequences(spark):
    docs = [*texts(), (900, "says <|endoftext|> here"), (901, "\U0001F600" * 400)]
    for limit, items in ((64, 10), (1024, 20_000)):
        rows = pack(documents(spark, docs), tokenizer_file(), limit=limit, node_items=items).collect()
        n, total = check(rows, docs, limit)
        assert n <= 1.1 * total / limit + 2


def test_no_rows_and_only_large_items(spark):
    assert pack(documents(spark, []), tokenizer_file()).collect() == []
    docs = [(i, "w " * 40) for i in range(30)]  # none of them fit together
    rows = pack(documents(spark, docs), tokenizer_file(), limit=64, node_items=4).collect()
    assert len({r.sequence_id for r in rows}) == 30


def test_repeated_runs_are_the_same(spark):
    docs = documents(spark, texts()).coalesce(1)
    a, b = (sorted(map(tuple, pack(docs, tokenizer_file()).drop("sequence_id").collect()), key=str) for _ in range(2))
    assert a == b


def test_best_fit_takes_the_fullest_bin():
    bins = best_fit([6, 5, 4, 3, 2], 10)
    assert sorted(sorted(x) for x in bins) == [[0, 2], [1, 3, 4]]


def test_ids_are_those_of_the_library():
    exact, ids = Tokenizer.from_file(tokenizer_file()), ids_of(tokenizer_file())
    for text in ("", "It's  a\n\n test", "naïve 漢字 १२३  \u0085x", "<|endoftext|>", "a" * 5000, "\t\t\t end  "):
        assert ids(text) == exact.encode(text, add_special_tokens=False).ids
