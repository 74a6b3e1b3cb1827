"""Records of text files that many tasks read, where a record may hold the character that ends lines.

A file is read in pieces that end with one character: lines of delimited text, or what stands up to each closing
brace of JSON. Whether a piece begins inside quotes, and how deep in brackets, is not known where a split of the file
begins. So each split first reports, for both cases, how it ends and how much deeper. Put one after the
other, these give the true state at the beginning of every split; then all splits are cut into records at the
same time. Only what crosses from one split into the next, two parts of each split, is joined afterwards.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema

from tablegauge.functions.session import fresh_path

#: Rows that a task hands on at a time.
BATCH_ROWS = 5_000

MOVE = pa.schema([
    ("file", pa.string()), ("block", pa.int64()), ("outside_ends_inside", pa.bool_()), ("outside_deeper", pa.int64()),
    ("inside_ends_inside", pa.bool_()), ("inside_deeper", pa.int64()), ("opened", pa.bool_())])
#: What a part of a record is: all of it, the end of one from an earlier split, the beginning of one, or neither end.
WHOLE, LAST, FIRST, MIDDLE = range(4)
PART = pa.schema([("file", pa.string()), ("block", pa.int64()), ("at", pa.int64()), ("part", pa.int32()), ("value", pa.string())])


class Delimited:
    """Lines of delimited text: quotes count where they begin a cell, and a doubled one is a quote."""

    end = "\n"

    def __init__(self, sep: str = ","):
        s = re.escape(sep)
        other = rf"(?:(?!{s}).)*+" if len(sep) > 1 else rf"[^{s}]*+"
        cell = rf'(?:"(?:[^"]++|"")*+"{other}|(?!"){other})'
        self.whole = re.compile(rf"{cell}(?:{s}{cell})*+", re.DOTALL)
        self.rest = re.compile(rf'(?:[^"]++|"")*+"{other}(?:{s}{cell})*+', re.DOTALL)
        self.cell = re.compile(rf"(?:^|{s})({cell}|.*)", re.DOTALL)

    def moved(self, piece: str, inside: bool) -> tuple[bool, int]:
        """Whether the next line begins inside quotes; lines do not nest."""
        if '"' not in piece:
            return inside, 0
        return not (self.rest if inside else self.whole).fullmatch(piece.removesuffix("\r")), 0

    def closes(self, inside: bool, depth: int) -> bool:
        return not inside

    def cells(self, record: str) -> list[str]:
        """The cells of one record; quotes around a cell are taken off."""
        return [c[1:-1].replace('""', '"') if len(c) > 1 and c[0] == c[-1] == '"' else c for c in self.cell.findall(record)]

    def text(self, pieces: list[str]) -> str:
        return "\n".join(p.removesuffix("\r") for p in pieces)


class Braces:
    """JSON up to each closing brace, which closes a record at the outermost depth, or inside an array of records at depth one.

    A string holds no line break, so one that is not closed ends with its line. After a record whose brackets do not
    match, what follows in the file is part of that record.
    """

    end = "}"
    _STRING = re.compile(r'"(?:[^"\\\n]++|\\[^\n])*+(?:"|(?=\n))')
    _CLOSED = re.compile(r'(?:[^"\\\n]++|\\[^\n])*+(?:"|(?=\n))')

    def moved(self, piece: str, inside: bool) -> tuple[bool, int]:
        """Whether the brace after the piece stands in a string, and how much deeper the piece leads."""
        if inside:
            closed = self._CLOSED.match(piece)
            if not closed:
                return True, 0
            piece = piece[closed.end():]
        if '"' in piece:
            piece = self._STRING.sub("", piece)
        open_ = piece.find('"')
        if open_ >= 0:
            piece = piece[:open_]
        deeper = piece.count("{") + piece.count("[") - piece.count("]")
        return open_ >= 0, deeper - (open_ < 0)

    def closes(self, inside: bool, depth: int) -> bool:
        return not inside and depth <= 0

    def text(self, pieces: list[str]) -> str:
        return "}".join(pieces)


Rules = Delimited | Braces


def pieces(spark: SparkSession, paths: str | list[str], end: str) -> DataFrame:
    """(file, block, value): the text up to each ``end``, in the order of the file within each split of it."""
    text = spark.read.option("recursiveFileLookup", True).option("lineSep", end).text(paths)
    return text.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value")


def _runs(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[tuple[str, int], Iterator[str]]]:
    """The pieces of each split, one split after the other."""
    rows = ((key, value) for batch in batches for key, value in zip(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()), batch.column(2).to_pylist()))
    current = next(rows, None)

    def own(key: tuple[str, int]) -> Iterator[str]:
        nonlocal current
        while current is not None and current[0] == key:
            yield current[1]
            current = next(rows, None)

    while current is not None:
        key = current[0]
        values = own(key)
        yield key, values
        for _ in values:  # whatever was not asked for
            pass


def moves(some: DataFrame, rules: Rules) -> DataFrame:
    """One row for each split that has pieces: how it ends, begun outside or inside quotes. A piece that changes nothing may be missing."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (file, block), values in _runs(batches):
            outside, inside, out_by, in_by, opened = False, True, 0, 0, False
            for value in values:
                before = outside
                outside, by = rules.moved(value, outside)
                out_by += by
                opened |= outside and not before
                if inside == before:  # both cases have met
                    inside, in_by = outside, in_by + by
                else:
                    inside, by = rules.moved(value, inside)
                    in_by += by
            yield pa.RecordBatch.from_pylist([dict(zip(MOVE.names, (file, block, outside, out_by, inside, in_by, opened)))], schema=MOVE)

    return some.select("file", "block", "value").mapInArrow(run, from_arrow_schema(MOVE))


def beginnings(found: list, base: dict[str, int]) -> dict[tuple[str, int], tuple[bool, int]]:
    """The state at the beginning of each split that does not begin outside quotes at depth zero.

    ``found`` are the rows of ``moves``: one of each split, no more than the splits that Spark's own plan of the scan lists.
    ``base`` is the depth of a file's records.
    """
    out: dict[tuple[str, int], tuple[bool, int]] = {}
    file, inside, depth = None, False, 0
    for r in sorted(found, key=lambda r: (r["file"], r["block"])):
        if r["file"] != file:
            file, inside, depth = r["file"], False, -base.get(r["file"], 0)
        if inside or depth:
            out[file, r["block"]] = inside, depth
        inside, depth = (r["inside_ends_inside"], depth + r["inside_deeper"]) if inside else (r["outside_ends_inside"], depth + r["outside_deeper"])
    return out


def records(every: DataFrame, rules: Rules, begin: dict[tuple[str, int], tuple[bool, int]]) -> DataFrame:
    """(file, block, at, value): all records of all pieces, written to the shared folder; the last of a file may lack its end.

    ``begin`` is the state of the splits that begin inside quotes or brackets. ``at`` numbers the records that begin in a split.
    What stands after the last brace of a file counts as if one followed. Records of white space only are passed over.
    """
    spark = every.sparkSession

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []

        def flushed(least: int) -> Iterator[pa.RecordBatch]:
            if len(rows) > least:
                yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows), PART)], schema=PART)
                rows.clear()

        for (file, block), values in _runs(batches):
            inside, depth = begin.get((file, block), (False, 0))
            at, held, begun = 0, [], not inside and depth <= 0
            for value in values:
                held.append(value)
                inside, by = rules.moved(value, inside)
                depth += by
                if rules.closes(inside, depth):
                    text = rules.text(held) + (rules.end if rules.end != "\n" else "")
                    if not begun or text.strip():
                        rows.append((file, block, at, WHOLE if begun else LAST, text))
                        at += 1
                    held, begun = [], True
                    yield from flushed(BATCH_ROWS)
            if held:
                rows.append((file, block, at, FIRST if begun else MIDDLE, rules.text(held) + rules.end))
        yield from flushed(0)

    path = fresh_path(spark, "records")
    every.select("file", "block", "value").mapInArrow(run, from_arrow_schema(PART)).write.partitionBy("part").option("compression", "zstd").parquet(path)
    parts = spark.read.schema(from_arrow_schema(PART)).parquet(path)
    whole = parts.where(F.col("part") == WHOLE).select("file", "block", "at", "value")
    order = Window.partitionBy("file").orderBy("block", "at")
    number = F.sum(F.when(F.col("part") == FIRST, 1).otherwise(0)).over(order)
    joined = parts.where(F.col("part") != WHOLE).withColumn("n", number).groupBy("file", "n").agg(
        F.min(F.struct("block", "at")).alias("first"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "at", "value"))), lambda x: x["value"]), "").alias("value"),
        F.bool_or(F.col("part") == LAST).alias("closed"))
    # Where no end came, the last piece was given one that the file does not have.
    trimmed = F.when(F.col("closed"), F.col("value")).otherwise(F.substring("value", F.lit(1), F.length("value") - 1))
    return whole.unionByName(joined.select("file", "first.block", "first.at", trimmed.alias("value"))).where(F.translate("value", " \t\r\n", "") != "")
