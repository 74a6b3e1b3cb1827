"""Benchmark decontamination by winnowing, in DataFrame functions only.

The k-grams of a text get a hash each, and every window of consecutive k-grams keeps the least one: its
fingerprint. With ``k`` words and ``size - k + 1`` k-grams to a window, a window spans ``size`` words, so two
texts that share ``size`` words in a row share the fingerprint of that span. Neighbouring windows mostly keep
the same hash and travel as one run. Runs whose fingerprint the benchmark has are extended: each of
their windows is compared word by word with the benchmark's windows.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablegauge.llm.common import staged

#: Words before A-Z is lowered: digits, ASCII letters and everything beyond ASCII.
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Windows of the benchmark that are broadcast at a time; a larger benchmark is matched in blocks of this size.
BLOCK_WINDOWS = 200_000


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of the value, which is computed once however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words_of(text: Column) -> Column:
    """The words as written; none of a null text."""
    return F.regexp_extract_all(F.coalesce(text.cast("string"), F.lit("")), F.lit(WORD), F.lit(0))


def window_text(words: Column, start: Column, n: Column | int) -> Column:
    """``n`` words from ``start`` (from 0) with A-Z lowered, joined by spaces."""
    n = F.lit(n) if isinstance(n, int) else n
    return F.translate(F.array_join(F.slice(words, start + 1, n), " "), UPPER, LOWER)


def lowered(words: Column) -> Column:
    """Words that are equal after A-Z is lowered are equal here; this need not hold the other way round."""
    return F.transform(words, lambda w: F.lower(w))


def runs(words: Column, size: int, k: int) -> Column:
    """Array of (len, print, first, last): windows ``first`` to ``last`` of ``size`` words keep the hash ``print``."""
    width = size - k + 1
    none = F.expr("cast(array() as array<struct<len:int,print:bigint,first:int,last:int>>)")

    def collapsed(least: Column) -> Column:
        changes = F.filter(
            F.sequence(F.lit(0), F.size(least) - 1),
            lambda i: (i == 0) | (F.get(least, i) != F.get(least, i - 1)))
        return let(changes, lambda at: F.transform(at, lambda i, j: F.struct(
            F.lit(size).alias("len"), F.get(least, i).alias("print"), i.alias("first"),
            (F.coalesce(F.get(at, j + 1), F.size(least)) - 1).alias("last"))))

    def winnowed(hashes: Column) -> Column:
        least = F.transform(F.sequence(F.lit(0), F.size(hashes) - width), lambda i: F.array_min(F.slice(hashes, i + 1, width)))
        return let(least, collapsed)

    def hashed(w: Column) -> Column:
        grams = F.transform(F.sequence(F.lit(0), F.size(w) - k), lambda i: F.xxhash64(F.slice(w, i + 1, k)))
        return F.when(F.size(w) >= size, let(grams, winnowed)).otherwise(none)

    return let(lowered(words), hashed)


def grams(words: Column, n: int) -> Column:
    """The same for whole spans of ``n`` words, fewer than a window has: one entry per position."""
    none = F.expr("cast(array() as array<struct<len:int,print:bigint,first:int,last:int>>)")
    return let(lowered(words), lambda w: F.when(F.size(w) >= n, F.transform(
        F.sequence(F.lit(0), F.size(w) - n),
        lambda i: F.struct(F.lit(n).alias("len"), F.xxhash64(F.slice(w, i + 1, n)).alias("print"), i.alias("first"), i.alias("last")))).otherwise(none))


def benchmark_windows(items: DataFrame, size: int) -> DataFrame:
    """(item, len, window, words): every window of every item; one shorter window of an item with fewer words."""
    words = items.select(F.col("item_id").cast("string").alias("item"), words_of(F.col("text")).alias("words")).where(F.size("words") > 0)
    n = F.least(F.size("words"), F.lit(size))
    each = words.select("item", "words", n.alias("len"), F.explode(F.sequence(F.lit(0), F.size("words") - n)).alias("at"))
    part = F.slice("words", F.col("at") + 1, F.col("len"))
    return each.select("item", "len", window_text(F.col("words"), F.col("at"), F.col("len")).alias("window"), part.alias("words"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, size: int = 10, k: int = 5) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated of every row of ``docs``.

    ``docs`` needs ``doc_id`` and ``text``, ``benchmark`` ``item_id`` and ``text``; other columns are not read. A null
    or empty text has no words and no hits. Repeated rows give a row each, rows that share an id but not
    the text are judged apart. Items without words match nothing; an item with a null id is counted in
    ``n_hit`` but not among the items. With an empty benchmark nothing is hit.
    """
    if not 1 <= k <= size:
        raise ValueError("k must be from 1 to size")
    spans = staged(benchmark_windows(benchmark, size), "benchmark")
    # One print per window: the least k-gram hash of a whole window, the hash of a shorter one.
    whole = runs(F.col("words"), size, k)
    shorts = [r[0] for r in spans.where(F.col("len") < size).select("len").distinct().orderBy("len").collect()]  # fewer than size
    prints = spans.select("len", F.explode(whole).alias("r")).select("len", "r.print")
    for n in shorts:
        prints = prints.unionByName(spans.where(F.col("len") == n).select("len", F.explode(grams(F.col("words"), n)).alias("r")).select("len", "r.print"))
    prints = staged(prints.distinct(), "prints")
    windows = staged(spans.select("len", "window").distinct(), "windows")

    text = F.col("text").cast("string")
    rows = docs.select(F.col("doc_id"), F.xxhash64(text).alias("version"), words_of(text).alias("words"))
    itself = F.array(F.struct(F.lit(0).alias("len"), F.lit(0).cast("bigint").alias("print"), F.lit(0).alias("first"), F.size("words").alias("last")))
    entries = F.concat(itself, runs(F.col("words"), size, k), *[grams(F.col("words"), n) for n in shorts])
    exploded = rows.select("doc_id", "version", "words", F.explode(entries).alias("e")).select("doc_id", "version", "words", "e.*")
    # The entry of length 0 stands for the row itself and passes with the first block.
    own = prints.sparkSession.range(1).select(F.lit(0).alias("len"), F.lit(0).cast("bigint").alias("print"))
    asked = [p.unionByName(own) if not i else p for i, p in enumerate(blocks(prints, ["len", "print"]))] or [own]
    met = None
    for block in asked:
        part = exploded.join(F.broadcast(block), ["len", "print"], "left_semi")
        met = part if met is None else met.unionByName(part)
    found = F.when(F.col("len") > 0, F.transform(F.sequence("first", "last"), lambda s: F.struct(s.alias("at"), window_text(F.col("words"), s, F.col("len")).alias("window"))))
    met = staged(met.select("doc_id", "version", "len", F.col("last").alias("n_words"), found.alias("found")), "met")

    key = ["doc_id", "version"]
    tried = met.where("len > 0").select(*key, "len", F.explode("found").alias("f")).select(*key, "len", "f.at", "f.window")
    hits = None
    for block in blocks(windows, ["len", "window"]):
        part = tried.join(F.broadcast(block), ["len", "window"], "left_semi")
        hits = part if hits is None else hits.unionByName(part)
    hits = staged((tried.limit(0) if hits is None else hits).distinct(), "hits")

    def covered(acc: Column, s: Column) -> Column:
        end = s["at"] + s["len"]
        return F.struct((acc["n"] + F.greatest(F.lit(0), end - F.greatest(s["at"], acc["end"]))).cast("bigint").alias("n"), F.greatest(end, acc["end"]).alias("end"))

    places = F.array_sort(F.collect_set(F.struct("at", "len")))
    n_hit = F.aggregate(places, F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(0).alias("end")), covered)["n"]
    by_words = hits.groupBy(*key).agg(n_hit.alias("n_hit"))
    seen = hits.select(*key, "len", "window").distinct()
    items = None
    for block in blocks(spans.select("len", "window", "item").distinct(), ["len", "window", "item"]):
        part = seen.join(F.broadcast(block), ["len", "window"]).select(*key, "item").distinct()
        items = part if items is None else items.unionByName(part)
    if items is None:
        items = seen.select(*key, F.col("window").alias("item"))
    by_items = items.distinct().groupBy(*key).agg(F.array_sort(F.collect_set("item")).alias("items"))

    def same(other: DataFrame) -> Column:
        return out["doc_id"].eqNullSafe(other["doc_id"]) & (out["version"] == other["version"])

    out = met.where("len = 0").select("doc_id", "version", F.col("n_words").cast("bigint"))
    judged = by_words.join(by_items.withColumnsRenamed({"doc_id": "i", "version": "v"}), F.col("doc_id").eqNullSafe(F.col("i")) & (F.col("version") == F.col("v")), "left").select(*key, "n_hit", "items")
    listed = F.coalesce("items", F.expr("cast(array() as array<string>)"))
    return out.join(judged, same(judged), "left").select(
        out["doc_id"], "n_words", F.coalesce("n_hit", F.lit(0)).cast("bigint").alias("n_hit"), F.size(listed).cast("bigint").alias("n_items"),
        F.sha2(F.array_join(listed, ","), 256).alias("items_sha256"), F.coalesce(F.col("n_hit") > 0, F.lit(False)).alias("contaminated"), out["version"].alias("text_xxhash64"))


def blocks(rows: DataFrame, by: list[str]) -> list[DataFrame]:
    """The rows in parts of about ``BLOCK_WINDOWS`` rows, dealt by hash; each is small enough to broadcast."""
    n = math.ceil(rows.count() / BLOCK_WINDOWS)
    if n < 2:
        return [rows] * n
    return [rows.where(F.pmod(F.xxhash64(*by), F.lit(n)) == i) for i in range(n)]
