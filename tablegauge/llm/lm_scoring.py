"""Scores of whole texts under language models learned from the corpus.

Two models are learned from the documents outside the held-out fold: the counts of words over the whole
corpus, and a causal self-attention model on subword ids whose classes and shares come from the counts of
all subwords and whose weights are trained in numpy. Training runs where the data is: each partition trains on windows that
cover all its documents, the weights are averaged, and the next round begins from the average.

A text is scored in overlapping windows: a window begins ``WINDOW - OVERLAP`` subwords after the one before and
scores what that one did not, so every subword counts once, with up to a whole window of context. The
probability of a word is interpolated between what the attention model gives its subwords and its smoothed share
of the corpus.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema

from tablegauge.llm import attention as A
from tablegauge.llm.chunks import Words, bucket_bits, chunked, coded, cut_at, decoded, steps, unpacked
from tablegauge.llm.common import arrow_table, staged
from tablegauge.llm.packing import byte_letters, ids_of
from tablegauge.llm.simhash import LOWER

#: Subwords that a window shares with the one before.
OVERLAP = 8
#: Rounds of training and averaging; each uses all windows.
ROUNDS = 3
RATE, BATCH = 0.01, 64
#: Windows scored at a time.
SCORED = 64
#: Bytes of text that a task looks at together.
TEXT_BYTES = 2 << 20
#: Arrays that are added up in one task.
FAN = 64
#: Weight of the attention model in the probability of a word.
ATTENTION = 0.2

GATHERED = pa.schema([("kind", pa.string()), ("bucket", pa.int32()), ("chunk", pa.int64()), ("n", pa.int32()), ("keys", pa.binary()), ("counts", pa.binary()), ("words", pa.int64()), ("texts", pa.int64())])
TOLD = pa.schema([("chunk", pa.int64()), ("bucket", pa.int32()), ("counts", pa.binary()), ("known", pa.int64())])
SUM = pa.schema([("at", pa.int64()), ("weight", pa.float64()), ("values", pa.binary())])
SCORE = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])


def is_held_out(doc_id: int | None, folds: int, fold: int) -> bool:
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % folds == fold


class Subwords:
    """Subword ids of words, each with the space before it."""

    def __init__(self, path: str):
        self.ids = ids_of(path)
        known = [len(self.ids.fast.decode_single_token_bytes(i)) for i in range(self.ids.fast.max_token_value + 1)]
        self.octets = np.array(known, dtype=np.int64)

    @cached_property
    def exact(self):
        from tokenizers import Tokenizer

        own = Tokenizer.from_file(self.ids.path)
        own.encode_special_tokens = True  # their strings in a text are ordinary text
        return own

    def encoded(self, text: str) -> list[int]:
        """The ids of a text; what the faster library refuses, as it does very long runs of white space, goes to the other."""
        try:
            return self.ids.fast.encode_ordinary(text)
        except BaseException as refused:  # its panic is no Exception
            if isinstance(refused, KeyboardInterrupt | SystemExit):
                raise
        return self.exact.encode(text, add_special_tokens=False).ids

    def __call__(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """All ids one after the other, and how many each word has.

        The words are encoded in one line. Its ids fall into words, as the tokenizer cuts before each space;
        should an odd white space within a word have it cut elsewhere, the words are encoded one by one.
        """
        if not words:
            return np.empty(0, dtype=np.int32), np.empty(0, dtype=np.int64)
        sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1
        found = np.array(self.encoded((b" " + b" ".join(words)).decode("utf-8", "surrogatepass")), dtype=np.int32)
        begins = np.cumsum(self.octets[found]) - self.octets[found]
        wanted = np.cumsum(sizes) - sizes
        at = np.searchsorted(begins, wanted)
        if (begins[np.minimum(at, len(begins) - 1)] == wanted).all():
            return found, np.diff(np.append(at, len(found)))
        each = [self.encoded(" " + w.decode("utf-8", "surrogatepass")) for w in words]
        return np.array([i for e in each for i in e], dtype=np.int32), np.array([len(e) for e in each], dtype=np.int64)


_subwords: dict[str, Subwords] = {}


def subwords_of(path: str) -> Subwords:
    if path not in _subwords:
        _subwords[path] = Subwords(path)
    return _subwords[path]


def vocabulary_marks(path: str) -> tuple[int, int, np.ndarray]:
    """Size of the vocabulary, the id that ends a text, and which ids begin a word."""
    encode = ids_of(path)
    size = encode.exact.get_vocab_size()
    end = encode.exact.token_to_id(encode.special[0])
    space = byte_letters()[32]
    return size, end, np.array([(encode.exact.id_to_token(i) or "").startswith(space) for i in range(size)])


class Text:
    """A chunk as distinct words and, per text, the sequence of words and the end, in units and in subwords."""

    def __init__(self, payload: bytes):
        self.ids, texts = unpacked(payload)
        self.words = Words([t.translate(LOWER) for t in texts])
        self.keys, self.some, self.which = np.unique(self.words.hashes, return_index=True, return_inverse=True)
        self.sizes = np.diff(self.words.first)

    def distinct(self) -> list[bytes]:
        line, starts, ends = self.words.line, self.words.starts, self.words.ends
        return [line[a:b] for a, b in zip(starts[self.some].tolist(), ends[self.some].tolist())]

    def tokens(self, path: str, end: int) -> None:
        """Fills in ``units`` (the end is the last number), ``flat`` ids and where units and texts begin in it."""
        flat, sizes = subwords_of(path)(self.distinct())
        self.unit_ids, self.unit_sizes = np.concatenate([flat, [end]]).astype(np.int32), np.concatenate([sizes, [1]])
        self.units = np.insert(self.which, self.words.first[1:], len(self.keys))
        begins = np.concatenate([[0], np.cumsum(self.unit_sizes)[:-1]])
        lengths = self.unit_sizes[self.units]
        self.at = np.cumsum(lengths) - lengths
        self.flat = self.unit_ids[np.repeat(begins[self.units] - self.at, lengths) + np.arange(int(lengths.sum()))]
        self.text_units = np.cumsum(self.sizes + 1) - (self.sizes + 1)
        self.text_at = np.concatenate([self.at[self.text_units], [len(self.flat)]]) if len(self.units) else np.zeros(1, dtype=np.int64)


def windows_of(text_at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Begin of every window, the end of its text, and the first place that it scores."""
    sizes = np.diff(text_at)
    stride = A.WINDOW - OVERLAP
    number = 1 + np.maximum(0, -(-(sizes - A.WINDOW) // stride))
    text = np.repeat(np.arange(len(sizes)), number)
    nth = np.arange(int(number.sum())) - np.repeat(np.cumsum(number) - number, number)
    begin = text_at[:-1][text] + nth * stride
    return begin, text_at[1:][text], begin + np.where(nth > 0, OVERLAP, 0)


def log_probabilities(p: dict, vocabulary: A.Vocabulary, flat: np.ndarray, text_at: np.ndarray, end: int) -> np.ndarray:
    """Natural log probability of every subword after those before it in its text."""
    before = np.concatenate([[end], flat[:-1]])
    before[text_at[:-1]] = end
    rows, kinds = vocabulary.row[before], vocabulary.kind[flat]
    out = vocabulary.log_share[flat].astype(np.float64)
    begin, until, first = windows_of(text_at)
    space = A.Space()
    for at in range(0, len(begin), SCORED):
        places = begin[at:at + SCORED, None] + np.arange(A.WINDOW)
        counted = (places < until[at:at + SCORED, None]) & (places >= first[at:at + SCORED, None])
        places = np.minimum(places, len(flat) - 1)
        out[places[counted]] += A.class_log_probabilities(p, rows[places], kinds[places], counted, space)
    return out


def summed(arrays: DataFrame, kind: str) -> tuple[float, np.ndarray | None]:
    """Total weight and sum of the arrays ``values``, added up in a tree of tasks with ``FAN`` arrays each."""

    def add(key: tuple, group: pa.Table) -> pa.Table:
        rows = group.to_pylist()
        rows.sort(key=lambda r: (r["at"], r["weight"]))
        total = sum(np.frombuffer(r["values"], dtype=kind) for r in rows)
        return pa.Table.from_pydict({"at": [key[0].as_py()], "weight": [sum(r["weight"] for r in rows)], "values": [total.tobytes()]}, schema=SUM)

    now = staged(arrays.select("at", "weight", "values"), "sums")
    while now.count() > FAN:
        order = now.select(F.floor(F.col("at") / FAN).cast("bigint").alias("to"), "at", "weight", "values")
        last, now = now.count(), staged(order.groupBy("to").applyInArrow(add, from_arrow_schema(SUM)), "sums")
        if now.count() >= last:
            raise ValueError("at must number the arrays")
    rows = sorted(now.collect(), key=lambda r: (r["at"], r["weight"]))
    if not rows:
        return 0.0, None
    return sum(r["weight"] for r in rows), sum(np.frombuffer(bytes(r["values"]), dtype=kind) for r in rows)


def gather(chunks: DataFrame, path: str, folds: int, fold: int, top: int) -> DataFrame:
    """What the corpus says, by chunk: counts of its words by hash, of subwords, and training windows."""
    size, end, _ = vocabulary_marks(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_seen, n_words, n_texts = np.zeros(size, dtype=np.int64), 0, 0
        empty = {"bucket": 0, "chunk": 0, "n": 0, "keys": b"", "counts": b"", "words": 0, "texts": 0}
        for batch in batches:
            for chunk, payload in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                text = Text(payload)
                text.tokens(path, end)
                learned = np.array([not is_held_out(i, folds, fold) for i in text.ids], dtype=bool)
                counts = np.bincount(text.which[learned[text.words.doc]], minlength=len(text.keys)).astype("<u4")
                buckets = (text.keys >> np.uint64(64 - top)).astype(np.int64) if top else np.zeros(len(text.keys), dtype=np.int64)
                rows = [empty | {"kind": "words", "bucket": k, "chunk": chunk, "n": b - a, "keys": coded(steps(text.keys[a:b].astype("<u8"))), "counts": coded(counts[a:b])}
                        for k, a, b in cut_at(buckets)]
                unit_counts = np.concatenate([counts, [learned.sum()]])
                ids_seen += np.bincount(text.unit_ids, weights=np.repeat(unit_counts, text.unit_sizes), minlength=size).astype(np.int64)
                n_words, n_texts = n_words + int(text.sizes[learned].sum()), n_texts + int(learned.sum())
                if len(windows := training_windows(text, learned, end)):
                    rows.append(empty | {"kind": "windows", "chunk": chunk, "n": len(windows), "keys": coded(windows.reshape(-1))})
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=GATHERED)
        yield pa.RecordBatch.from_pylist([empty | {"kind": "subwords", "chunk": TaskContext.get().partitionId(), "n": size, "counts": ids_seen.tobytes(), "words": n_words, "texts": n_texts}], schema=GATHERED)

    return staged(chunks.select("chunk", "payload").mapInArrow(run, from_arrow_schema(GATHERED)), "gathered")


def training_windows(text: Text, learned: np.ndarray, end: int) -> np.ndarray:
    """Consecutive windows of the learned texts, each after the id before it; every subword is a target once.

    A place behind the end of the text is -1.
    """
    sizes = np.diff(text.text_at)[learned]
    number = -(-sizes // A.WINDOW)
    nth = np.arange(int(number.sum())) - np.repeat(np.cumsum(number) - number, number)
    begin = np.repeat(text.text_at[:-1][learned], number) + nth * A.WINDOW
    until = np.repeat(text.text_at[1:][learned], number)
    places = begin[:, None] + np.arange(-1, A.WINDOW)
    out = np.where(places < until[:, None], text.flat[np.clip(places, 0, max(0, len(text.flat) - 1))], -1) if len(begin) else places
    out[nth == 0, 0] = end
    return out.astype("<i4")


def word_counts(gathered: DataFrame) -> DataFrame:
    """(chunk, bucket, counts, known): the corpus counts of a chunk's words in their order.

    ``known`` adds up to the number of distinct words that were counted.
    """

    def count(key: tuple, group: pa.Table) -> pa.Table:
        rows = group.sort_by("chunk").to_pylist()
        keys = np.concatenate([np.cumsum(decoded(r["keys"], r["n"], "<u8"), dtype=np.uint64) for r in rows])
        _, inverse = np.unique(keys, return_inverse=True)
        totals = np.bincount(inverse, weights=np.concatenate([decoded(r["counts"], r["n"], "<u4") for r in rows])).astype("<u8")
        ends = np.cumsum([r["n"] for r in rows])
        return pa.Table.from_pydict({
            "chunk": [r["chunk"] for r in rows], "bucket": [key[0].as_py()] * len(rows),
            "counts": [coded(totals[inverse[e - r["n"]:e]]) for e, r in zip(ends, rows)],
            "known": [int((totals > 0).sum()), *[0] * (len(rows) - 1)]}, schema=TOLD)

    words = gathered.where("kind = 'words'").select("bucket", "chunk", "n", "keys", "counts")
    return staged(words.groupBy("bucket").applyInArrow(count, from_arrow_schema(TOLD)), "counts")


def train(gathered: DataFrame, vocabulary: A.Vocabulary, flat: np.ndarray, rounds: int) -> np.ndarray:
    """The weights after some rounds of training on each partition's windows and averaging."""
    windows = gathered.where("kind = 'windows'").select("n", "keys")

    def fitted(now: np.ndarray) -> Callable:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own, node, n, weight = now, TaskContext.get().partitionId(), 0, 0
            for batch in batches:
                for size, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    ids = decoded(blob, size * (A.WINDOW + 1), "<i4").reshape(size, A.WINDOW + 1)
                    kinds = np.where(ids[:, 1:] >= 0, vocabulary.kind[np.maximum(ids[:, 1:], 0)], -1)
                    own = A.trained(own, vocabulary.row[np.maximum(ids[:, :-1], 0)], kinds, RATE, BATCH, n)
                    n, weight = n + 1, weight + len(ids)
            if weight:
                yield arrow_table({"at": [node], "weight": [float(weight)], "values": [(own.astype(np.float64) * weight).tobytes()]}, SUM)

        return run

    for _ in range(rounds):
        weight, total = summed(windows.mapInArrow(fitted(flat), from_arrow_schema(SUM)), "<f8")
        if total is not None:
            flat = (total / weight).astype(np.float32)
    return flat


def held_out(doc_id: Column, folds: int = 7, fold: int = 2) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % folds == fold, F.lit(False))


def score_texts(docs: DataFrame, tokenizer: str, folds: int = 7, fold: int = 2, rounds: int = ROUNDS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row.

    ``docs`` needs ``doc_id`` and ``text``; other columns are not read. Tokens are the words, with A-Z lowered, and one
    end; a null or empty text is the end alone. ``base_score`` adds log10((c + 1) / (N + V + 1)), ``score`` is the
    log10 probability under the mixture of both models. A null id is learned from. Repeated rows count
    each. Where nothing may be learned, all counts are zero and the attention model is untrained.
    """
    size, end, begins = vocabulary_marks(tokenizer)
    chunks = chunked(docs, "chunks", TEXT_BYTES)
    top = min(20, bucket_bits(chunks))
    gathered = gather(chunks, tokenizer, folds, fold, top)
    told = word_counts(gathered)
    told_known = told.agg(F.sum("known")).first()[0] or 0
    n_words, n_texts = [x or 0 for x in gathered.agg(F.sum("words"), F.sum("texts")).first()]
    n_train, n_distinct = n_words + n_texts, told_known + (n_texts > 0)
    subwords = gathered.where("kind = 'subwords'").select(F.col("chunk").alias("at"), F.lit(1.0).alias("weight"), F.col("counts").alias("values"))
    _, seen = summed(subwords, "<i8")
    seen = np.zeros(size, dtype=np.int64) if seen is None else seen
    vocabulary = A.Vocabulary.of(seen, begins, end)
    flat = train(gathered, vocabulary, A.initial(vocabulary, seen), rounds)
    least = np.log(1.0 / (n_train + n_distinct + 1))

    def score(key: tuple, chunk: pa.Table, counts: pa.Table) -> pa.Table:
        if not chunk.num_rows:
            return SCORE.empty_table()
        text = Text(chunk.column("payload")[0].as_py())
        text.tokens(tokenizer, end)
        own = np.zeros(len(text.keys) + 1, dtype=np.int64)
        own[-1] = n_texts
        buckets = (text.keys >> np.uint64(64 - top)).astype(np.int64) if top else np.zeros(len(text.keys), dtype=np.int64)
        given = {r["bucket"]: r["counts"] for r in counts.select(["bucket", "counts"]).to_pylist()}
        for k, a, b in cut_at(buckets):
            own[a:b] = decoded(given[k], b - a, "<u8")
        base = (np.log(own + 1.0) + least)[text.units]
        known = (own > 0)[text.units]
        deep = np.add.reduceat(log_probabilities(A.unflat(flat), vocabulary, text.flat, text.text_at, end), text.at)
        both = np.logaddexp(np.log(ATTENTION) + deep, np.log1p(-ATTENTION) + base)
        per_text = [np.add.reduceat(x, text.text_units) for x in (known.astype(np.int64), base, both)]
        return pa.Table.from_batches([arrow_table({
            "doc_id": text.ids, "held_out": [is_held_out(i, folds, fold) for i in text.ids], "n_tokens": text.sizes + 1,
            "n_known": per_text[0], "base_score": per_text[1] / np.log(10), "score": per_text[2] / np.log(10)}, SCORE)])

    scored = chunks.select("chunk", "payload").groupBy("chunk").cogroup(told.select("chunk", "bucket", "counts").groupBy("chunk")).applyInArrow(score, from_arrow_schema(SCORE))
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(n_train).cast("bigint").alias("train_tokens"), "base_score", "score")
