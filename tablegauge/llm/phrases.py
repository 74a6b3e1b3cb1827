"""Phrases whose words stand together more often than their parts suggest, counted by an FM-index per shard.

A shard is some megabytes of text as word ids. Its index is the Burrows-Wheeler transform of that sequence and of
the reversed one, sorted as deep as the longest phrase. An interval of rows stands for a phrase; it is extended by a
word to the left in the one transform or to the right in the other, and its place in both is kept up to date. So a shard lists
its phrases level by level with their counts, and only where both shorter phrases inside may be frequent.

Whether a phrase may be frequent is decided over all shards: they send hashes and counts by bucket of the hash,
and get back a bit for each. A sum over a hash is never below the true count, so nothing is lost; what is left
travels as text, a block for each shard and bucket, and its counts are exact.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema

from tablegauge.functions.joins import joined_by_key
from tablegauge.llm.chunks import bits, coded, cut_at, decoded, mixed, steps, unbits
from tablegauge.llm.common import arrow_table, staged, text_groups

#: Bytes of text in a shard; a longer document is a shard of its own.
SHARD_BYTES = 6 << 20
#: Words of the corpus per bucket of hashes; a bucket holds at most two entries per word.
BUCKET_WORDS = 1_000_000
#: Candidates among which one task looks for the first ones of a language.
RANKED_AT_ONCE = 100_000
#: What ends a piece, and what lies between words.
ENDS, GAPS = b".,;:!?\n\x0b\x0c\r", b" \t"
#: Language of a null.
UNKNOWN = "und"

TO_MARKS = bytes.maketrans(ENDS + GAPS, b"." * len(ENDS) + b" " * len(GAPS))
FACTOR = np.uint64(0xD1342543DE82EF95)

SHARD = pa.schema([
    ("shard", pa.int64()), ("n", pa.int64()), ("before", pa.binary()), ("after", pa.binary()), ("words", pa.binary()), ("n_bytes", pa.int64()),
    ("lang_of", pa.binary()), ("langs", pa.list_(pa.struct([("lang", pa.string()), ("n", pa.int64())])))])
ENTRY = pa.schema([("bucket", pa.int64()), ("shard", pa.int64()), ("n", pa.int64()), ("keys", pa.binary()), ("counts", pa.binary())])
ANSWER = pa.schema([("shard", pa.int64()), ("step", pa.int32()), ("bucket", pa.int64()), ("flags", pa.binary())])
BLOCK = pa.schema([("bucket", pa.int64()), ("block", pa.binary())])
COUNT = pa.schema([("lang", pa.string()), ("phrase", pa.string()), ("length", pa.int32()), ("a", pa.int64())])


class Vocabulary(dict):
    """Ids of the words of one language, given when a word is first met."""

    def __init__(self, words: list[bytes]):
        super().__init__({b".": 0})
        self.words = words

    def __missing__(self, word: bytes) -> int:
        self.words.append(word)
        self[word] = len(self.words)
        return len(self.words)


def ordered(line: np.ndarray, depth: int) -> np.ndarray:
    """Places of the line, ordered by the ``depth`` ids from each place on; the line is a ring."""
    known = {1: line.astype(np.int64)}

    def rank(d: int) -> np.ndarray:
        if d not in known:
            _, known[d] = np.unique(key(d), return_inverse=True)
        return known[d]

    def key(d: int) -> np.ndarray:
        first, rest = rank(d // 2), rank(d - d // 2)
        return first * (int(rest.max()) + 1) + np.roll(rest, -(d // 2))

    return np.argsort(key(depth) if depth > 1 else known[1], kind="stable")


def transformed(line: np.ndarray, depth: int) -> np.ndarray:
    """For each place in that order the id before it."""
    return line[ordered(line, depth) - 1]


def shard_row(number: int, langs: list[str | None], texts: list[bytes | None], depth: int) -> dict:
    """The index of some texts."""
    words: list[bytes] = []
    known: dict[str, Vocabulary] = {}
    parts, counts, lang_of = [np.zeros(1, dtype=np.int32)], {}, []
    names: dict[str, int] = {}
    for lang, text in zip(langs, texts):
        lang = UNKNOWN if lang is None else lang
        own, at = known.setdefault(lang, Vocabulary(words)), names.setdefault(lang, len(names))
        tokens = (text or b"").lower().translate(TO_MARKS).replace(b".", b" . ").split()
        ids = np.fromiter(map(own.__getitem__, tokens), dtype=np.int32, count=len(tokens))
        lang_of += [at] * (len(words) - len(lang_of))
        parts += [ids, parts[0]]
        counts[lang] = counts.get(lang, 0) + int(np.count_nonzero(ids))
    line = np.concatenate(parts)
    line = line[np.concatenate([[True], (line[1:] > 0) | (line[:-1] > 0)])]
    blob = b"\n".join(words)
    return {
        "shard": number, "n": len(line), "before": coded(transformed(line, depth)), "after": coded(transformed(line[::-1], depth)),
        "words": pa.compress(blob, codec="zstd", asbytes=True), "n_bytes": len(blob), "lang_of": coded(np.array(lang_of, dtype=np.int32)),
        "langs": [{"lang": k, "n": v} for k, v in counts.items()]}


class Phrases:
    """Phrases of one length: their rows in both transforms, counts, hashes and words."""

    def __init__(self, first: np.ndarray, last: np.ndarray, count: np.ndarray, raw: np.ndarray, words: np.ndarray):
        self.first, self.last, self.count, self.raw, self.words = first, last, count, raw, words

    def __getitem__(self, some: np.ndarray) -> Phrases:
        return Phrases(self.first[some], self.last[some], self.count[some], self.raw[some], self.words[some])

    @property
    def hashes(self) -> np.ndarray:
        return mixed(self.raw + np.uint64(self.words.shape[1]))


class Side:
    """One transform: the id on the other side of each row, and where the row with that id in front lies."""

    def __init__(self, ids: np.ndarray):
        self.ids = ids
        self.row = np.empty(len(ids), dtype=np.int64)
        self.row[np.argsort(ids, kind="stable")] = np.arange(len(ids))

    def extended(self, here: np.ndarray, there: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, ...]:
        """Each phrase with each word next to it: (phrase, word, rows here, rows there, count)."""
        begins = np.cumsum(count) - count
        owner = np.repeat(np.arange(len(count)), count)
        rows = np.arange(len(owner)) + np.repeat(here - begins, count)
        key = owner * (int(self.ids.max()) + 1) + self.ids[rows]
        order = np.argsort(key, kind="stable")
        key = key[order]
        at = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, dtype=np.int64)
        which, first = owner[order[at]], rows[order[at]]
        # In the other transform the rows of a phrase are ordered by exactly this neighbour.
        return which, self.ids[first], self.row[first], there[which] + at - begins[which], np.diff(at, append=len(key))


def covered(places: np.ndarray, starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Whether each place lies in one of the disjoint intervals."""
    if not len(starts):
        return np.zeros(len(places), dtype=bool)
    order = np.argsort(starts)
    at = np.searchsorted(starts[order], places, side="right") - 1
    return (at >= 0) & (places < (starts + counts)[order][np.maximum(at, 0)])


class Shard:
    """An index as it was stored."""

    def __init__(self, row: dict):
        self.number = row["shard"]
        self.before, self.after = (Side(decoded(row[c], row["n"], "<i4")) for c in ("before", "after"))
        blob = pa.decompress(row["words"], decompressed_size=row["n_bytes"], codec="zstd", asbytes=True) if row["n_bytes"] else b""
        self.words = blob.split(b"\n") if blob else []
        self.langs = [x["lang"] for x in row["langs"]]
        self.lang_of = decoded(row["lang_of"], len(self.words), "<i4")
        seeds = [xxhash.xxh64_intdigest(name.encode("utf-8", "surrogatepass")) for name in self.langs]
        self.hashes = np.fromiter((xxhash.xxh64_intdigest(w, seeds[k]) for w, k in zip(self.words, self.lang_of.tolist())), dtype=np.uint64, count=len(self.words))

    def single(self) -> Phrases:
        counts = np.bincount(self.before.ids, minlength=len(self.words) + 1)
        starts = (np.cumsum(counts) - counts)[1:]
        return Phrases(starts, starts, counts[1:], self.hashes, np.arange(1, len(self.words) + 1, dtype=np.int32)[:, None])

    def longer(self, own: Phrases) -> Phrases:
        """All phrases of one word more both of whose parts, without the last and without the first word, are among ``own``."""
        size = own.words.shape[1]
        if size % 2:
            which, word, first, last, count = self.before.extended(own.first, own.last, own.count)
            keep = (word > 0) & covered(first, own.first, own.count)
        else:
            which, word, last, first, count = self.after.extended(own.last, own.first, own.count)
            keep = (word > 0) & covered(last, own.last, own.count)
        which, word, first, last, count = (x[keep] for x in (which, word, first, last, count))
        added = self.hashes[word - 1]
        if size % 2:
            return Phrases(first, last, count, added + FACTOR * own.raw[which], np.column_stack([word, own.words[which]]))
        power = np.uint64(pow(int(FACTOR), size, 1 << 64))
        return Phrases(first, last, count, own.raw[which] + power * added, np.column_stack([own.words[which], word]))

    def levels(self, told: list[dict[int, bytes]], steps_of: list[range], buckets: int) -> list[Phrases]:
        """The phrases of each length that the answers so far leave, and all of the next step's lengths."""
        out: list[Phrases] = []
        for step, lengths in enumerate(steps_of[:len(told) + 1]):
            own = []
            for _ in lengths:
                own.append(self.longer((out + own)[-1]) if out or own else self.single())
            out += own if step == len(told) else flagged(own, told[step], buckets)
        return out


def bucket_of(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Number of the bucket, ascending with the key."""
    return ((keys >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def entries(shard: int, own: list[Phrases], buckets: int) -> list[dict]:
    """Rows of hashes and counts, one for each bucket."""
    keys, inverse = np.unique(np.concatenate([p.hashes for p in own]), return_inverse=True)
    counts = np.bincount(inverse, weights=np.concatenate([p.count for p in own]), minlength=len(keys)).astype("<u4")
    return [{"bucket": k, "shard": shard, "n": b - a, "keys": coded(steps(keys[a:b].astype("<u8"))), "counts": coded(counts[a:b])} for k, a, b in cut_at(bucket_of(keys, buckets))]


def flagged(own: list[Phrases], flags: dict[int, bytes], buckets: int) -> list[Phrases]:
    """The phrases whose hash has a set bit in the answers, which are in the order of ``entries``."""
    keys, inverse = np.unique(np.concatenate([p.hashes for p in own]), return_inverse=True)
    good = np.zeros(len(keys), dtype=bool)
    for k, a, b in cut_at(bucket_of(keys, buckets)):
        good[a:b] = unbits(flags[k], b - a)
    ends = np.cumsum([len(p.count) for p in own])
    return [p[good[inverse[e - len(p.count):e]]] for p, e in zip(own, ends)]


def summed(step: int, least: int) -> Callable:
    """Over all shards, which hashes of a bucket are counted often enough."""

    def run(key: tuple, group: pa.Table) -> pa.Table:
        rows = group.sort_by("shard").to_pylist()
        keys = np.concatenate([np.cumsum(decoded(r["keys"], r["n"], "<u8"), dtype=np.uint64) for r in rows])
        counts = np.concatenate([decoded(r["counts"], r["n"], "<u4") for r in rows])
        _, inverse = np.unique(keys, return_inverse=True)
        often = (np.bincount(inverse, weights=counts) >= least)[inverse]
        ends = np.cumsum([r["n"] for r in rows])
        return pa.Table.from_pydict({
            "shard": [r["shard"] for r in rows], "step": [step] * len(rows), "bucket": [key[0].as_py()] * len(rows),
            "flags": [bits(often[e - r["n"]:e]) for e, r in zip(ends, rows)]}, schema=ANSWER)

    return run


def packed(rows: pa.RecordBatch) -> bytes:
    """The rows as one compressed value."""
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, rows.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", 1))) as out:
        out.write_batch(rows)
    return sink.getvalue().to_pybytes()


def indexed(docs: DataFrame, depth: int) -> DataFrame:
    """The shards of all rows of ``docs`` (lang, text), written to the shared folder."""

    size = SHARD_BYTES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = TaskContext.get().partitionId() << 32
        for i, group in enumerate(text_groups(batches, "text", size)):
            row = shard_row(first + i, group.column(0).to_pylist(), group.column(1).cast(pa.binary()).to_pylist(), depth)
            if row["n"] > 1:
                yield arrow_table({k: [v] for k, v in row.items()}, SHARD)

    columns = (F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    return staged(docs.select(*columns).mapInArrow(run, from_arrow_schema(SHARD)), "shards")


def phrase_counts(docs: DataFrame, longest: int = 5, least: int = 100) -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, length, a): every phrase of 1 to ``longest`` words that occurs ``least`` times in its language
    and only such phrases, save that a single word is listed where it occurs so often; and (lang, n), all words."""
    shards = indexed(docs, longest)
    totals = shards.select(F.explode("langs").alias("x")).groupBy("x.lang").agg(F.sum("x.n").alias("n"))
    total = shards.agg(F.sum("n")).first()[0] or 0
    buckets = max(1, -(-total // BUCKET_WORDS))
    steps_of = [range(1, 3), range(3, longest + 1)] if longest > 2 else [range(1, 3)]

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                own = Shard(row)
                yield from pa.Table.from_pylist(entries(own.number, own.levels([], steps_of, buckets), buckets), schema=ENTRY).to_batches()

    def opened(shard: pa.Table, told: pa.Table, n: int) -> tuple[Shard, list[Phrases]]:
        flags: list[dict[int, bytes]] = [{} for _ in range(n)]
        for r in told.to_pylist():
            flags[r["step"]][r["bucket"]] = r["flags"]
        own = Shard(shard.to_pylist()[0])
        return own, own.levels(flags, steps_of, buckets)

    def deeper(key: tuple, shard: pa.Table, told: pa.Table) -> pa.Table:
        own, found = opened(shard, told, 1)
        found = [p for p in found[2:] if len(p.count)]
        return pa.Table.from_pylist(entries(own.number, found, buckets) if found else [], schema=ENTRY)

    def listed(key: tuple, shard: pa.Table, told: pa.Table) -> pa.Table:
        own, found = opened(shard, told, len(steps_of))
        out = []
        for p in found:
            at = bucket_of(p.hashes, buckets)
            order = np.argsort(at, kind="stable")
            for bucket, a, b in cut_at(at[order]):
                some = p[order[a:b]]
                rows = [[own.words[w - 1] for w in row] for row in some.words.tolist()]
                out.append({"bucket": bucket, "block": packed(arrow_table({
                    "lang": [own.langs[k] for k in own.lang_of[some.words[:, 0] - 1].tolist()], "phrase": [b" ".join(r).decode("utf-8", "surrogatepass") for r in rows],
                    "length": [some.words.shape[1]] * len(rows), "a": some.count}, COUNT))})
        return pa.Table.from_pylist(out, schema=BLOCK)

    def total_counts(key: tuple, group: pa.Table) -> pa.Table:
        every = pa.concat_tables([pa.ipc.open_stream(b).read_all() for b in group.column("block").to_pylist()])
        every = every.group_by(["lang", "phrase", "length"]).aggregate([("a", "sum")]).rename_columns({"a_sum": "a"})
        return every.filter(pa.compute.greater_equal(every.column("a"), least)).select(COUNT.names).cast(COUNT)

    by_shard = shards.groupBy("shard")
    answers = staged(shards.mapInArrow(probe, from_arrow_schema(ENTRY)).groupBy("bucket").applyInArrow(summed(0, least), from_arrow_schema(ANSWER)), "answers")
    if len(steps_of) > 1:
        tried = by_shard.cogroup(answers.groupBy("shard")).applyInArrow(deeper, from_arrow_schema(ENTRY))
        second = staged(tried.groupBy("bucket").applyInArrow(summed(1, least), from_arrow_schema(ANSWER)), "answers")
        answers = answers.unionByName(second)
    found = by_shard.cogroup(answers.groupBy("shard")).applyInArrow(listed, from_arrow_schema(BLOCK))
    return staged(found.groupBy("bucket").applyInArrow(total_counts, from_arrow_schema(COUNT)), "phrases"), totals


def scored(counts: DataFrame, totals: DataFrame, ratio: int) -> DataFrame:
    """lang, phrase, a, l, r, n, score, cut, widest: candidates with their lowest cut, without those inside a longer phrase.

    ``widest`` is the count of the most frequent phrase that has one word more, null if none is a candidate. A phrase of more words is inside one of
    one word more that is at least as frequent, so those with one word more decide.
    """
    words, phrase = F.split("phrase", " "), F.col("phrase")
    longer = counts.where("length > 2").select("lang", "a", words.alias("w"), (F.col("length") - 1).alias("k"))
    inside = longer.select("lang", "a", F.explode(F.array(F.array_join(F.slice("w", F.lit(1), F.col("k")), " "), F.array_join(F.slice("w", F.lit(2), F.col("k")), " "))).alias("phrase"))
    widest = inside.groupBy("lang", "phrase").agg(F.max("a").alias("widest"))
    candidates = counts.where("length > 1").join(widest, ["lang", "phrase"], "left").where(F.col("widest").isNull() | (F.col("widest") * 100 < F.col("a") * ratio))
    cuts = candidates.select("*", words.alias("w"), F.explode(F.sequence(F.lit(1), F.col("length") - 1)).alias("cut")).select(
        "lang", "phrase", "a", "widest", "cut", F.array_join(F.slice("w", F.lit(1), F.col("cut")), " ").alias("head"),
        F.array_join(F.slice("w", F.col("cut") + 1, F.col("length") - F.col("cut")), " ").alias("tail"))
    parts = counts.select("lang", phrase.alias("part"), F.col("a").alias("f"))
    cuts = cuts.join(parts.select("lang", F.col("part").alias("head"), F.col("f").alias("l")), ["lang", "head"])
    cuts = cuts.join(parts.select("lang", F.col("part").alias("tail"), F.col("f").alias("r")), ["lang", "tail"])
    cuts = joined_by_key(cuts, totals, ["lang"])
    # Products in 38 digits; a quotient of at most 10 n fits 64 bits.
    wide = "decimal(19,0)"
    score = F.expr(f"(cast(a as {wide}) * 1000 * cast(n as {wide})) div (cast(l as {wide}) * cast(r as {wide}))")
    best = F.min(F.struct(score.alias("score"), "cut", "l", "r")).alias("best")
    return cuts.groupBy("lang", "phrase", "a", "n", "widest").agg(best).select("lang", "phrase", "a", "best.l", "best.r", "n", "best.score", "best.cut", "widest")


def first_of_each(rows: DataFrame, top: int) -> DataFrame:
    """``rows`` of ``scored`` with ``rank``, the first ``top`` of each language, found in rounds of bounded groups."""
    left = staged(rows, "candidates")
    while (most := left.groupBy("lang").count().agg(F.max("count")).first()[0] or 0) > max(RANKED_AT_ONCE, 2 * top):
        groups = -(-most // max(RANKED_AT_ONCE, 2 * top))
        best = Window.partitionBy("lang", "salt").orderBy(F.desc("score"), F.desc("a"), "phrase")
        left = staged(left.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(groups))).withColumn("at", F.row_number().over(best)).where(F.col("at") <= top).drop("salt", "at"), "candidates")
    order = F.struct((-F.col("score")).alias("s"), (-F.col("a")).alias("b"), "phrase", "l", "r", "n", "cut", "widest")
    kept = left.groupBy("lang").agg(F.slice(F.array_sort(F.collect_list(order)), 1, top).alias("x")).select("lang", F.posexplode("x").alias("at", "x"))
    return kept.select("lang", (F.col("at") + 1).alias("rank"), "x.phrase", (-F.col("x.b")).alias("a"), "x.l", "x.r", "x.n", (-F.col("x.s")).alias("score"), "x.cut", "x.widest")


def mine_phrases(docs: DataFrame, longest: int = 5, least: int = 100, ratio: int = 100, top: int = 2_000) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score, cut, widest: the ``top`` phrases of each language.

    ``docs`` needs ``lang`` and ``text``; other columns are not read. A to Z count as small letters; ``. , ; : ! ?``
    and line breaks end a piece, words are what lies between blanks and tabs, and a phrase lies within a piece. ``a`` counts the
    phrase with overlaps, ``n`` all words of its language. Of the cuts in two parts with counts ``l`` and ``r``
    the one with the lowest ``floor(1000 a n / (l r))`` gives the score, the first of equal ones. Phrases of two to ``longest`` words
    with ``a >= least`` are candidates; one that lies inside a longer one with at least ``ratio`` per cent of its count is left
    out. A null text is empty, a null language ``und``. Repeated rows count each. Without a candidate, or
    for an empty table, there are no rows. Ties in score go to the larger ``a``, then to the phrase first in byte order.
    """
    if longest < 2 or least < 1:
        raise ValueError("phrases have at least two words and occur at least once")
    return first_of_each(scored(*phrase_counts(docs, longest, least), ratio), top)
