"""Chat formatting of logged conversations, in DataFrame functions only.

A log often holds the same conversation several times, each time with some more turns. Every turn gets a
hash of the turns up to it (an exclusive or of position-bound hashes, so it rolls along in a window).
A conversation whose last hash is an inner hash of another one is a prefix of it: an anti-join
drops it, and only maximal conversations are rendered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablegauge.llm.common import staged


def _turns(turns: DataFrame) -> DataFrame:
    return turns.where(F.col("conv_id").isNotNull()).select(
        "conv_id", "turn", F.coalesce(F.col("role").cast("string"), F.lit("unknown")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


def _marks() -> tuple[Column, Column]:
    """Two hashes of what a turn says."""
    return F.xxhash64("role", "text").alias("h1"), F.xxhash64(F.lit("second"), "text", "role").alias("h2")


def maximal_conversations(turns: DataFrame) -> DataFrame:
    """(conv_id, n_turns, n_copies) of conversations that are no proper prefix of another one.

    Of equal conversations the one with the least id stands for all ``n_copies``.
    """
    said = _turns(turns).select("conv_id", "turn", *_marks()).distinct()
    order = Window.partitionBy("conv_id").orderBy("turn", "h1", "h2")
    so_far = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = said.select("conv_id", "turn", "h1", "h2", F.row_number().over(order).alias("at"), F.lead(F.lit(1)).over(order).isNull().alias("last"))
    rolled = placed.select(
        "conv_id", "at", "last",
        F.bit_xor(F.xxhash64("at", "h1", "h2")).over(so_far).alias("p1"),
        F.bit_xor(F.xxhash64("h2", "at", "h1")).over(so_far).alias("p2"))
    prefixes = staged(rolled, "prefixes")
    whole = prefixes.where("last").groupBy("p1", "p2", "at").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_copies"))
    inner = prefixes.where("not last").select("p1", "p2", "at").distinct()
    return whole.join(inner, ["p1", "p2", "at"], "left_anti").select("conv_id", F.col("at").cast("bigint").alias("n_turns"), "n_copies")


def format_conversations(turns: DataFrame, opening: str = "<|{role}|>\n", closing: str = "<|end|>\n") -> DataFrame:
    """conv_id, n_turns, n_copies, text of every maximal conversation.

    ``turns`` needs conv_id, turn, role and text; other columns are not read. Rows without a conv_id belong
    to no conversation. A row that repeats another one of its conversation counts once; different rows with
    one turn number stand in a fixed order of their content, a null number comes first. A null role is
    ``unknown``, a null text is empty. No rows give none. A conversation is one row, so it must fit in one.
    """
    before, after = opening.split("{role}")
    kept = maximal_conversations(turns)
    said = _turns(turns).select("conv_id", "turn", *_marks(), "role", "text")
    whole = said.join(kept, "conv_id").groupBy("conv_id").agg(
        F.first("n_turns").alias("n_turns"), F.first("n_copies").alias("n_copies"),
        F.array_sort(F.collect_set(F.struct("turn", "h1", "h2", "role", "text"))).alias("said"))
    return whole.select("conv_id", "n_turns", "n_copies", F.array_join(F.transform(
        "said", lambda t: F.concat(F.lit(before), t["role"], F.lit(after), t["text"], F.lit(closing))), "").alias("text"))
