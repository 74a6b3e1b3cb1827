"""Small tables for the tests of the text operators."""

from __future__ import annotations

import random
import re

from pyspark.sql import DataFrame, SparkSession

#: Columns whose names the operators use inside.
CLASHES = ("chunk", "bits", "bucket", "node", "to", "words", "version", "len", "found", "n", "at", "pivot", "part", "h1", "level", "least")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def documents(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    """(doc_id, text) with other columns, some of whose names clash."""
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint, " + ", ".join(f"`{c}` string" for c in CLASHES)
    full = [(i, t, "en", "src0", None if t is None else len(t), *["x"] * len(CLASHES)) for i, t in rows]
    return spark.createDataFrame(full, schema).repartition(3)


def prose(seed: int, n: int, vocabulary: int = 400) -> str:
    """Words drawn from a fixed list, with some breaks and capitals."""
    own = random.Random(seed)
    words = [f"w{own.randrange(vocabulary)}" for _ in range(n)]
    return "".join((w.upper() if own.random() < 0.05 else w) + own.choice([" ", "  ", "\n", "\t", " "]) for w in words)


def texts(n: int = 60) -> list[tuple]:
    """Documents with copies, near copies, shared passages, long and empty ones, nulls and odd characters."""
    own = random.Random(3)
    out: list[tuple] = [(i, prose(i, own.choice([0, 1, 2, 5, 19, 20, 21, 60, 200]))) for i in range(n)]
    shared = prose(999, 45)
    for i in range(5, n, 7):
        out[i] = (i, f"{prose(i, 30)} {shared} {prose(i + 1, 30)}")
    out += [(n, out[12][1]), (n + 1, out[12][1]), (n + 2, out[12][1] + " more"), (n + 3, None), (n + 4, ""), (n + 5, " \n\t "),
            (n + 6, "a " * 300), (n + 7, prose(5, 6000)), (n + 8, "é ß 漢字 🙂   x" * 30), (7, out[7][1]), (None, prose(1, 50)), (n + 9, "x" * 50_000)]
    return out
