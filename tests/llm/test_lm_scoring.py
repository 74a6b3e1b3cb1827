"""Language-model scores: counts by brute force, the attention model against plain formulas."""

import math
import zlib
from collections import Counter

import numpy as np
import pytest

from tablegauge.llm import attention as A
from tablegauge.llm import lm_scoring as L
from tablegauge.llm.chunks import chunked, coded, decoded
from tablegauge.llm.common import table
from tablegauge.llm.packing_query import tokenizer_file
from tests.llm.helpers import LOWER, WORD, documents, prose, texts


def held(i):
    return i is not None and zlib.crc32(str(i).encode()) % 7 == 2


def brute(docs):
    tokens = [(i, [*WORD.findall((t or "").translate(LOWER)), None]) for i, t in docs]
    counts = Counter(w for i, ws in tokens if not held(i) for w in ws)
    n, v = sum(counts.values()), len(counts)
    return sorted(((i, held(i), len(ws), sum(counts[w] > 0 for w in ws), n, round(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in ws), 6)) for i, ws in tokens), key=str)


def rounded(rows):
    return sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in rows), key=str)


@pytest.mark.parametrize("split", [False, True])
def test_counts_and_base_scores(spark, monkeypatch, split):
    if split:
        monkeypatch.setattr(L, "bucket_bits", lambda chunks: 4)
        monkeypatch.setattr(L, "TEXT_BYTES", 3_000)
        monkeypatch.setattr(L, "FAN", 2)
    docs = texts()
    rows = L.score_texts(documents(spark, docs), tokenizer_file()).collect()
    assert rounded(rows) == brute(docs)
    assert all(math.isfinite(r.score) and r.score < 0 for r in rows)


def test_empty_and_nothing_learned(spark):
    assert L.score_texts(documents(spark, []), tokenizer_file()).collect() == []
    out = [i for i in range(100) if held(i)][:3]
    rows = L.score_texts(documents(spark, [(i, "some words") for i in out]), tokenizer_file()).collect()
    assert {(r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in rows} == {(3, 0, 0, 0.0)}


def test_beats_the_base_on_held_out_texts(spark, sf_dir):
    rows = [r for r in L.score_texts(table(spark, sf_dir.replace("0.001", "0.01"), "documents"), tokenizer_file()).collect() if r.held_out]
    assert len(rows) > 50 and sum(r.score for r in rows) > sum(r.base_score for r in rows)


def small(seed=0):
    own = np.random.default_rng(seed)
    counts = own.integers(0, 50, 300)
    vocabulary = A.Vocabulary.of(counts, own.random(300) < 0.5, 299)
    return own, vocabulary, A.initial(vocabulary, counts)


def test_shares_of_a_class_add_up():
    _, vocabulary, _ = small()
    for kind in range(A.CLASSES):
        own = vocabulary.kind == kind
        assert not own.any() or abs(np.exp(vocabulary.log_share[own].astype(float)).sum() - 1) < 1e-3
    assert (vocabulary.kind == vocabulary.kind[299]).sum() == 1


def test_gradient_agrees_with_differences():
    own, vocabulary, flat = small()
    rows, kinds = own.integers(0, A.EMBEDDINGS, (3, A.WINDOW)), own.integers(-1, A.CLASSES, (3, A.WINDOW))

    def loss(x):
        return -A.class_log_probabilities(A.unflat(x.astype(np.float64)), rows, kinds, kinds >= 0).mean()

    wide = flat.astype(np.float64) * 3
    g = A.gradient(A.unflat(wide), rows, kinds)
    places = np.concatenate([np.flatnonzero(g)[::997], np.arange(len(flat) - 300, len(flat), 37)])
    for i in places:
        step = np.zeros_like(wide)
        step[i] = 1e-4
        assert abs((loss(wide + step) - loss(wide - step)) / 2e-4 - g[i]) < 1e-4


def test_large_weights_give_finite_probabilities():
    """Exponents that would vanish or overflow as they stand: each place has probabilities that add up to one."""
    own, _, flat = small()
    rows, one = own.integers(0, A.EMBEDDINGS, (2, A.WINDOW)), np.ones((2, A.WINDOW), dtype=bool)
    with np.errstate(all="raise", under="ignore"):
        p = A.unflat(flat * np.float32(60))
        by_class = np.stack([A.class_log_probabilities(p, rows, np.full(rows.shape, k), one) for k in range(A.CLASSES)])
        fit = A.trained(flat * np.float32(60), rows, own.integers(0, A.CLASSES, rows.shape), 0.01, 2, 1)
    assert np.isfinite(by_class).all() and np.allclose(np.exp(by_class.astype(float)).sum(axis=0), 1, atol=1e-3)
    assert np.isfinite(fit).all()


def test_model_is_causal_and_training_helps():
    own, _, flat = small()
    rows, kinds = own.integers(0, A.EMBEDDINGS, (4, A.WINDOW)), own.integers(0, A.CLASSES, (4, A.WINDOW))
    def scored(x):
        return A.class_log_probabilities(A.unflat(flat), x, kinds, np.ones(kinds.shape, dtype=bool)).reshape(kinds.shape)

    a = scored(rows)
    changed = rows.copy()
    changed[:, 20:] = 5
    b = scored(changed)
    assert np.allclose(a[:, :20], b[:, :20], atol=1e-6) and not np.allclose(a[:, 20:], b[:, 20:])
    pattern = np.tile(np.arange(8), (64, 5))
    fit = A.trained(flat, pattern[:, :A.WINDOW], pattern[:, 1:A.WINDOW + 1], 0.05, 8, 1)
    before, after = (A.class_log_probabilities(A.unflat(x), pattern[:1, :A.WINDOW], pattern[:1, 1:A.WINDOW + 1], np.ones((1, A.WINDOW), dtype=bool)).mean() for x in (flat, fit))
    assert after > before + 0.5


def test_every_subword_is_scored_once(monkeypatch):
    own, vocabulary, flat = small()
    p = A.unflat(flat)
    sizes = [1, 2, 31, 32, 33, 56, 57, 200]
    ids = own.integers(0, 299, sum(sizes)).astype(np.int32)
    text_at = np.concatenate([[0], np.cumsum(sizes)])
    monkeypatch.setattr(L, "SCORED", 3)
    got = L.log_probabilities(p, vocabulary, ids, text_at, 299)
    for a, b in zip(text_at, text_at[1:]):
        before = np.concatenate([[299], ids[a:b - 1]])
        for t in range(b - a):
            stride = A.WINDOW - L.OVERLAP
            nth = max(0, -(-(t + 1 - A.WINDOW) // stride))
            begin = nth * stride
            x = np.zeros((1, A.WINDOW), dtype=int)
            x[0, :t + 1 - begin] = vocabulary.row[before[begin:t + 1]]
            kinds = np.full((1, A.WINDOW), vocabulary.kind[ids[a + t]])
            wanted = np.zeros((1, A.WINDOW), dtype=bool)
            wanted[0, t - begin] = True
            found = A.class_log_probabilities(p, x, kinds, wanted)[0] + vocabulary.log_share[ids[a + t]]
            assert abs(found - got[a + t]) < 1e-4


def test_every_subword_of_a_learned_text_is_a_target_once(spark):
    docs = [(i, prose(i, n)) for i, n in enumerate([0, 1, 31, 32, 33, 700, 5000])] + [(None, None)]
    gathered = L.gather(chunked(documents(spark, docs), "chunks", 3_000), tokenizer_file(), 7, 2, 0)
    got, (_, end, _) = Counter(), L.vocabulary_marks(tokenizer_file())
    encode = L.subwords_of(tokenizer_file())
    for r in gathered.where("kind = 'windows'").collect():
        ids = decoded(bytes(r["keys"]), r["n"] * (A.WINDOW + 1), "<i4").reshape(-1, A.WINDOW + 1)
        got.update((int(a), int(b)) for a, b in zip(ids[:, :-1].flat, ids[:, 1:].flat) if b >= 0)
    wanted = Counter()
    for i, t in docs:
        if not held(i):
            words = [w.encode() for w in WORD.findall((t or "").translate(LOWER))]
            ids = [end, *encode(words)[0].tolist(), end]
            wanted.update(zip(ids, ids[1:]))
    assert got == wanted


def test_each_round_trains_on_all_windows(spark):
    own, vocabulary, flat = small()
    ids = own.integers(0, 299, (40, A.WINDOW + 1)).astype("<i4")
    rows = spark.createDataFrame([("windows", 40, bytearray(coded(ids.reshape(-1))))], "kind string, n int, keys binary").coalesce(1)
    expected = flat
    for _ in range(2):
        expected = A.trained(expected, vocabulary.row[ids[:, :-1]], vocabulary.kind[ids[:, 1:]], L.RATE, L.BATCH, 0)
    assert np.allclose(L.train(rows, vocabulary, flat, 2), expected, atol=1e-5)


@pytest.mark.parametrize("white", ["　", " "])
def test_long_runs_of_unicode_white_space(white):
    """A run of white space that one library refuses is encoded by the other, in one line with other words."""
    words = [b"some", (white * 1_000_000).encode(), b"<|endoftext|>", b"words"]
    ids, sizes = L.subwords_of(tokenizer_file())(words)
    assert len(sizes) == 4 and sizes.sum() == len(ids) and (sizes > 0).all()
    own = L.subwords_of(tokenizer_file())
    assert ids[:sizes[0]].tolist() == own.encoded(" some") and ids[-sizes[3]:].tolist() == own.encoded(" words")
