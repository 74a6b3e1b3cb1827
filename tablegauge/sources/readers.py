"""Readers: delimited text, JSON, a folder of files, and archives."""

from __future__ import annotations

import csv
import io
import itertools
import json
import re
import zipfile
from collections.abc import Iterable, Iterator, Mapping
from concurrent.futures import ThreadPoolExecutor
from functools import reduce
from urllib.parse import unquote

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from tablegauge.functions import keywords as K
from tablegauge.functions.failures import cannot_read
from tablegauge.functions.joins import joined_by_key
from tablegauge.functions.nulls import quoted
from tablegauge.functions.probes import NUMBER_PATTERN
from tablegauge.functions.session import fresh_path, local_rows
from tablegauge.sources.splits import Braces, Delimited, beginnings, moves, pieces, records

# Lines a task hands on at a time while it reads an archive member.
BATCH_LINES = 5_000
# Characters of a member among which its first line is looked for.
HEAD_CHARS = 1 << 20
# What reading the directory of a file raises that is none, or too short for one.
NO_ARCHIVE = (zipfile.BadZipFile, OSError, ValueError)
_INTEGER = r"^\s*[+-]?\d{1,18}\s*$"
_NUMBER = NUMBER_PATTERN + r"|^\s*[+-]?(inf|Inf|INF|infinity|Infinity)\s*$"


def null_tokens(c: Column) -> Column:
    """The text, or null where it is one of the tokens for "no value"."""
    return F.when(~c.isin(*K.NA_TOKENS), c)


def column_names(head: list[str | None]) -> list[str]:
    """Names for a header row: an empty cell becomes ``Unnamed: i``, a repeated name gets ``.1``, ``.2`` and so on.

    Names that differ in case only count as repeated, since Spark does not tell them apart.
    """
    out, taken = [], set()
    for i, cell in enumerate(head):
        name = cell or f"Unnamed: {i}"
        own, n = name, 0
        while own.lower() in taken:
            n += 1
            own = f"{name}.{n}"
        taken.add(own.lower())
        out.append(own)
    return out


def _fits(x: Column) -> dict[str, Column]:
    """Counts of the values that are not null, and of those that are an integer, a number, or a flag."""
    return {"n": F.count(x), "i": F.count_if(x.rlike(_INTEGER)), "d": F.count_if(x.rlike(_NUMBER)), "b": F.count_if(x.isin("True", "False", "TRUE", "FALSE", "true", "false"))}


def _typed(x: Column, rows: int, n: int, i: int, d: int, b: int) -> Column:
    """A text column as the type that all its values fit."""
    if n == 0:
        return F.lit(None).cast("double")  # a column without values counts as numeric
    if b == rows:  # flags with gaps stay text
        return F.lower(x) == "true"
    if i == n:
        return F.trim(x).try_cast("long")
    return F.trim(x).try_cast("double") if d == n else x


def type_columns(df: DataFrame) -> DataFrame:
    """Text columns typed by their whole content: boolean, long or double, else text as it is.

    One pass counts what fits; dates stay text, so that the type check can report them.
    """
    names = df.columns
    clean = df.select([null_tokens(quoted(c)).alias(c) for c in names])
    aggs = [F.count("*").alias("rows")]
    for k, c in enumerate(names):
        aggs += [count.alias(f"{what}{k}") for what, count in _fits(quoted(c)).items()]
    got = clean.agg(*aggs).first()
    return clean.select([_typed(quoted(c), got["rows"], *(got[f"{what}{k}"] for what in "nidb")).alias(c) for k, c in enumerate(names)])


# The record as it stands in the file, where its number of cells is not that of the header.
_ODD = "__odd_record"


def _path_of(file: str) -> str:
    """A path for the reader from one that the scan reports, where odd characters are escaped."""
    return unquote(file)


def _file_facts(lines: DataFrame) -> list:
    """file, head (its first line that is not blank), quoted (whether some line has a quote); one row per file."""
    filled = lines.where(F.trim("value") != "").withColumn("at", F.monotonically_increasing_id())
    return filled.groupBy("file").agg(F.min_by("value", F.struct("block", "at")).alias("head"), F.bool_or(F.contains("value", F.lit('"'))).alias("quoted")).orderBy("file").collect()


def _header(names: list[str]) -> T.StructType:
    return T.StructType([T.StructField(c, T.StringType()) for c in [*names, _ODD]])


def _fitting(raw: DataFrame, names: list[str], sep: str) -> tuple[DataFrame, DataFrame]:
    """Rows with no more cells than the header, and the other records as they stand with their number of cells."""
    bare = F.regexp_replace(_ODD, '"[^"]*"', "")
    cells = ((F.length(bare) - F.length(F.replace(bare, F.lit(sep), F.lit("")))) / len(sep)).cast("int") + 1
    surplus = F.col(_ODD).isNotNull() & (cells > len(names))
    return raw.where(~surplus).select([quoted(c) for c in names]), raw.where(surplus).select(F.col(_ODD).alias("record"), cells.alias("cells"))


def _whole_files(spark: SparkSession, paths: str | list[str], names: list[str], sep: str, multi_line: bool) -> tuple[DataFrame, DataFrame]:
    """The cells of files with one header, read by Spark's own reader."""
    # All cells are parsed, or else the parser would not see that there are too many.
    raw = spark.read.schema(_header(names)).option("columnPruning", False).option("recursiveFileLookup", True).csv(
        paths, header=True, enforceSchema=True, columnNameOfCorruptRecord=_ODD, multiLine=multi_line, **_cell_options(sep))
    # Spark refuses to read the record alone, so a condition that always holds takes the cells along.
    raw = raw.where(F.pmod(F.hash(*[quoted(c) for c in names]), F.lit(1)) == 0)
    return _fitting(raw, names, sep)


def _cell_options(sep: str) -> dict:
    return {"sep": sep, "quote": '"', "escape": '"', "nullValue": "", "mode": "PERMISSIVE"}


def _cut_files(lines: DataFrame, files: list[str], rules: Delimited, found: list) -> DataFrame:
    """All records of the files, those with breaks inside quotes too, cut by many tasks."""
    begin = beginnings([r for r in found if r["file"] in set(files)], {})
    return records(lines.where(F.col("file").isin(files)), rules, begin)


def scan_csv_rows(spark: SparkSession, path: str, sep: str = ",", multi_line: bool | None = None) -> tuple[DataFrame, DataFrame]:
    """Delimited text with a header row: the typed table, and the records that do not fit into it.

    A file is read by many tasks, with quoted line breaks or without. Each file of a folder is read by its own
    header, and cells meet by name; a column that a file lacks is null there. A record with fewer cells than its header is
    filled up with nulls. One with more is not cut but returned as it stands: ``record, cells``.
    ``multi_line=True`` reads each file by one task instead and takes whatever Spark's reader takes for a line break;
    ``multi_line=False`` spares the search for quoted breaks where there are none.
    """
    rules = Delimited(sep)
    lines = pieces(spark, path, rules.end)
    facts = _file_facts(lines)
    if not facts:
        raise ValueError(f"{path} has no header")
    doubtful = [] if multi_line is not None else [r["file"] for r in facts if r["quoted"]]
    found = moves(lines.where(F.contains("value", F.lit('"')) & (F.lit(len(doubtful) == len(facts)) | F.col("file").isin(doubtful))), rules).collect() if doubtful else []  # a row per split
    cut = sorted({r["file"] for r in found if r["opened"]})
    parts: list[tuple[DataFrame, DataFrame]] = []
    heads = {r["file"]: tuple(column_names(rules.cells(r["head"].removesuffix("\r").removeprefix("\ufeff")))) for r in facts if r["file"] not in cut}
    groups: dict[tuple, list[str]] = {}
    for file, head in heads.items():
        groups.setdefault(head, []).append(file)
    if multi_line and facts:  # a header may have breaks of its own
        groups = {}
        for r in facts:
            first = spark.read.csv(_path_of(r["file"]), header=False, inferSchema=False, multiLine=True, **_cell_options(sep)).first() if r["quoted"] else None
            groups.setdefault(tuple(column_names(list(first))) if first else heads[r["file"]], []).append(r["file"])
    for head, files in groups.items():
        paths = path if len(files) == len(facts) else [_path_of(f) for f in files]
        parts.append(_whole_files(spark, paths, list(head), sep, bool(multi_line)))
    if cut:
        rows = _cut_files(lines, cut, rules, found)
        is_head = (F.col("block") == 0) & (F.col("at") == 0)
        groups = {}
        for r in rows.where(is_head).orderBy("file").collect():  # a row per file
            groups.setdefault(tuple(column_names(rules.cells(r["value"].removeprefix("\ufeff")))), []).append(r["file"])
        for head, files in groups.items():
            own = rows.where(~is_head & (F.lit(len(files) == len(cut)) | F.col("file").isin(files)))
            cells = F.from_csv("value", ", ".join(f"`{c.replace('`', '``')}` string" for c in [*head, _ODD]), _cell_options(sep) | {"columnNameOfCorruptRecord": _ODD})
            parts.append(_fitting(own.select(cells.alias("x")).select("x.*"), list(head), sep))
    table = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [t for t, _ in parts])
    return type_columns(table), reduce(DataFrame.unionByName, [b for _, b in parts])


def scan_csv(spark: SparkSession, path: str, sep: str = ",", multi_line: bool | None = None) -> DataFrame:
    """The table of a delimited file or folder; refused if a record has more cells than its header.

    ``scan_csv_rows`` reads such a file and returns those records apart.
    """
    table, bad = scan_csv_rows(spark, path, sep, multi_line)
    first = bad.first()
    if first:
        raise ValueError(f"{path}: a record has {first['cells']} cells, its header fewer: {first['record'][:200]}")
    return table


# JSON.

def _parsed(rows: DataFrame) -> DataFrame:
    """file, record (where it is no JSON object), v: each text parsed once, written to the shared folder."""
    bare = F.trim(F.translate("value", "\t\r\n\ufeff", "   "))
    braces = F.startswith(bare, F.lit("{")) & F.endswith(bare, F.lit("}"))
    # In brackets, or else what follows a complete object would be passed over. A text without the braces of an object is not
    # tried, as a failing parse costs far more than a look at its ends.
    within = F.when(braces, F.try_parse_json(F.concat(F.lit("["), "value", F.lit("]"))))
    parsed = rows.select("file", "value", within.alias("x"), braces.alias("object")).select(
        "file", "value", "object", F.variant_get("x", "$[0]", "variant").alias("v"), F.variant_get("x", "$[1]", "variant").isNull().alias("single"))
    good = F.col("v").isNotNull() & F.col("single") & F.col("object")
    path = fresh_path(rows.sparkSession, "json")
    parsed.select("file", F.when(~good, F.col("value")).alias("record"), F.when(good, F.col("v")).alias("v")).write.parquet(path)
    return rows.sparkSession.read.parquet(path)


def _json_type(found: str) -> str:
    """The type of a column from the schema of its variants: decimals are doubles, and what has no one type is text."""
    return re.sub(r"\bVARIANT\b|\bVOID\b", "STRING", re.sub(r"DECIMAL\(\d+,\s*\d+\)", "DOUBLE", re.sub(r"\bOBJECT<", "STRUCT<", found)))


def _by_numbers(schema: T.StructType) -> bool:
    """Whether every column maps numbers to cells: a table stored by column."""
    return bool(schema.fields) and all(isinstance(f.dataType, T.StructType) and f.dataType.names and all(n.isdigit() for n in f.dataType.names) for f in schema)


def _fields_of(found: str) -> T.StructType:
    """The fields of this schema of variants; column-oriented ones are refused."""
    kind = T._parse_datatype_string(_json_type(found))
    if not isinstance(kind, T.StructType):
        return T.StructType()
    if _by_numbers(kind):
        raise ValueError("column-oriented JSON; records are expected")
    return kind


def _typed_variants(parsed: DataFrame, found: str) -> DataFrame:
    """The columns of variants with this schema."""
    kind = _fields_of(found)
    if not kind.fields:
        return parsed.where("v is not null").select()
    return parsed.where("v is not null").select([F.try_variant_get("v", f"$['{f.name}']" if "'" not in f.name else f'$["{f.name}"]', f.dataType.simpleString()).alias(f.name) for f in kind])


def _objects(parts: DataFrame, files: list[str], in_array: bool, cut_short: set[str]) -> DataFrame:
    """file, value: the elements of arrays, or objects over any number of lines, cut by many tasks.

    The last one of a file in ``cut_short``, and of an array without its bracket, is given as far as it goes.
    """
    rules, own = Braces(), parts.where(F.col("file").isin(files))
    cut = records(own, rules, beginnings(moves(own, rules).collect(), dict.fromkeys(files, 1) if in_array else {}))  # a row per split
    start = F.substring(F.translate("value", " \t\r\n", ""), 1, 3)
    lasts = cut.groupBy("file").agg(F.max_by(start, F.struct("block", "at")).alias("start"), F.max(F.struct("block", "at")).alias("x")).collect()  # a row per file
    # A file ends with a bracket or white space, which then stands before a brace that is not there.
    ends = [r for r in lasts if r["start"] in ("]}", "]", "[]}", "[]") or not in_array and r["start"] == "}"]
    short = [r for r in lasts if r not in ends and (in_array or r["file"] in cut_short)] + [r for r in ends if r["start"] == "}" and r["file"] in cut_short]

    def among(some: list) -> Column:
        return reduce(lambda a, b: a | b, [(F.col("file") == r["file"]) & (F.col("block") == r["x"]["block"]) & (F.col("at") == r["x"]["at"]) for r in some], F.lit(False))

    value = F.when(among(short), F.regexp_replace("value", r"\}\s*$", "")).otherwise(F.col("value"))
    return cut.where(~among(ends)).select("file", F.regexp_replace(value, r"^\ufeff?\s*[\[,]?\s*" if in_array else r"^\ufeff?\s*", "").alias("value"))


def json_records(spark: SparkSession, path: str) -> DataFrame:
    """file, record, v: every record of every JSON file below the path, as a variant, or as it stands where it is no JSON object.

    A file is an array of records, JSON lines, or objects over several lines. Arrays and such objects are cut between their
    elements, so that one large file is read by many tasks.
    """
    parts = pieces(spark, path, Braces.end)
    bare = F.ltrim(F.translate("value", "\t\r\n\ufeff", "   "))
    begun = parts.where(bare != "").select("file", "block", F.monotonically_increasing_id().alias("at"), F.substring(bare, 1, 1).alias("c"))
    firsts = begun.groupBy("file").agg(F.min_by("c", F.struct("block", "at")).alias("c")).collect()  # a row per file
    arrays, others = [r["file"] for r in firsts if r["c"] == "["], [r["file"] for r in firsts if r["c"] != "["]
    out = []
    if arrays:
        out.append(_parsed(_objects(parts, arrays, True, set())))
    if others:
        by_line = pieces(spark, [_path_of(f) for f in others], "\n").where(F.trim(F.translate("value", "\t\r", "  ")) != "")
        lines = _parsed(by_line)
        good = {r["file"]: r for r in lines.groupBy("file").agg(F.count("v").alias("n"), F.count("record").alias("bad")).collect()}  # a row per file
        odd = [f for f, r in good.items() if r["bad"]]
        if odd:
            # Objects over several lines, unless these do not parse either and some line does.
            tails = by_line.where(F.col("file").isin(odd)).withColumn("at", F.monotonically_increasing_id()).groupBy("file").agg(
                F.max_by(F.substring(F.rtrim(F.translate("value", "\t\r", "  ")), -1, 1), F.struct("block", "at")).alias("c")).collect()  # a row per file
            whole = _parsed(_objects(parts, odd, False, {r["file"] for r in tails if r["c"] != "}"}))
            broken = {r["file"] for r in whole.groupBy("file").agg(F.count("record").alias("bad")).collect() if r["bad"]}
            odd = [f for f in odd if f not in broken or not good[f]["n"]]
            out.append(whole.where(F.col("file").isin(odd)))
        out.append(lines.where(~F.col("file").isin(odd)) if odd else lines)
    if not out:
        raise ValueError(f"{path} has no records")
    return reduce(DataFrame.unionByName, out)


def scan_json_rows(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """JSON records: the typed table, and the records that are no JSON object, as they stand: ``record``.

    The files of a folder may each be an array of objects, JSON lines, or objects over several lines. A number with
    decimals is a double, and a column whose values have no common type is text. Column-oriented objects are refused.
    """
    parsed = json_records(spark, path)
    found = parsed.agg(F.expr("schema_of_variant_agg(v)").alias("x")).first()["x"]
    return _typed_variants(parsed, found), parsed.where("record is not null").select("record")


def scan_json(spark: SparkSession, path: str) -> DataFrame:
    """The table of JSON records; refused if a record is no JSON object.

    ``scan_json_rows`` reads such a file and returns those records apart.
    """
    table, bad = scan_json_rows(spark, path)
    first = bad.first()
    if first:
        raise ValueError(f"{path}: a record is no JSON object: {first['record'][:200]}")
    return table


READERS = {"csv": scan_csv, "json": scan_json}
ROW_READERS = {"csv": scan_csv_rows, "json": scan_json_rows}


def extension(path: str) -> str:
    name = path.rsplit("/", 1)[-1]
    return name.rsplit(".", 1)[-1].lower() if "." in name else ""


def scan_by_extension(spark: SparkSession, path: str) -> DataFrame:
    """The reader that belongs to the file's extension; Parquet is read as it is."""
    ext = extension(path.rstrip("/"))
    if ext == "parquet":
        return spark.read.parquet(path)
    if ext not in READERS:
        raise ValueError(f"unsupported file format: .{ext}")
    return READERS[ext](spark, path)


def is_data_file(path: str) -> bool:
    """A supported file that is neither hidden nor below a ``__MACOSX`` folder."""
    parts = path.split("/")
    return not parts[-1].startswith(".") and "__MACOSX" not in path and extension(path) in {*READERS, "parquet"}


def list_files(spark: SparkSession, folder: str) -> list[str]:
    """Supported files below a folder, as paths relative to it, sorted."""
    root = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    base = fs.makeQualified(root).toString().rstrip("/") + "/"
    found, walk = [], fs.listFiles(root, True)
    while walk.hasNext():
        path = walk.next().getPath().toString()
        if path.startswith(base):
            found.append(path[len(base):])
    return sorted(p for p in found if is_data_file(p))


def scan_catalog(spark: SparkSession, folder: str) -> tuple[dict[str, DataFrame], DataFrame]:
    """Every supported file below a folder, by relative path, and ``(table_name, error)`` rows: one for each
    file that cannot be read or is empty, and one for each record that does not fit its table."""
    def reader(path: str):
        whole = f"{folder.rstrip('/')}/{path}"
        return lambda: ROW_READERS.get(extension(path), scan_by_extension)(spark, whole)

    return _read_all(spark, {p: reader(p) for p in list_files(spark, folder)})


def _misfits(bad: DataFrame) -> DataFrame:
    """Error rows for the records (table_name, record, cells) that do not fit; ``cells`` is null where a record is no JSON object."""
    record = F.substring("record", 1, 400)
    return bad.select("table_name", F.when(F.col("cells").isNull(), F.concat(F.lit("record that is no JSON object: "), record)).otherwise(
        F.format_string("record with %d cells: %s", F.col("cells"), record)).alias("error"))


def _odd_records(name: str, bad: DataFrame) -> DataFrame:
    return _misfits(bad.select(F.lit(name).alias("table_name"), "record", (F.col("cells") if "cells" in bad.columns else F.lit(None)).cast("int").alias("cells")))


def _read_all(spark: SparkSession, readers: dict) -> tuple[dict[str, DataFrame], DataFrame]:
    tables, errors, misfits = {}, [], []
    for name, read in readers.items():
        try:
            df, bad = got if isinstance(got := read(), tuple) else (got, None)
            if bad is not None:
                misfits.append(_odd_records(name, bad))
            if not df.columns or df.isEmpty():
                errors.append((name, "empty table"))
            else:
                tables[name] = df
        except Exception as exc:  # one bad file must not end the scan
            if not cannot_read(exc):
                raise
            errors.append((name, str(exc).splitlines()[0][:500]))
    return tables, reduce(DataFrame.unionByName, misfits, local_rows(spark, errors, "table_name string, error string"))


# One record of a member per row: the cells of a delimited file, or the text of a JSON record.
CELLS = "archive string, member string, line_no long, cells array<string>, record string, error string"


class ZipMembers(DataSource):
    """The records of all data files inside ZIP archives, each member a partition of its own.

    Only the directory at the end of an archive is read to plan the scan, and a task reads the part of the archive
    that holds its member, as a stream.
    """

    @classmethod
    def name(cls) -> str:
        return "zip_members"

    def schema(self) -> str:
        return CELLS

    def reader(self, schema: T.StructType) -> ZipReader:
        return ZipReader(self.options["path"])


class ZipReader(DataSourceReader):
    """Plans and reads the members of an archive, or of the archives in a folder."""

    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> list[InputPartition]:
        with ThreadPoolExecutor(max_workers=16) as pool:  # a short read at the end of each archive
            return [InputPartition(m) for found in pool.map(_members, _archives(self.path)) for m in found] or [InputPartition(None)]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        if partition.value is None:
            return
        archive, member, error = partition.value
        if error:
            yield _batch(archive, "", [(0, None, None, error)])
            return
        fs, path = opened(archive)
        with fs.open_input_file(path) as file, zipfile.ZipFile(file) as z:
            yield from _member_records(archive, z, member)


def opened(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path, which may be without a scheme, and the path in it."""
    if "://" not in path:
        return pafs.LocalFileSystem(), path.removeprefix("file:")
    return pafs.FileSystem.from_uri(path)


def _archives(path: str) -> list[str]:
    """The files of a path: itself, or all archives below a folder."""
    fs, own = opened(path)
    prefix = path[:len(path) - len(own)] if path.endswith(own) else ""
    info = fs.get_file_info(own)
    if info.type == pafs.FileType.File:
        return [path]
    if info.type != pafs.FileType.Directory:
        raise ValueError(f"{path} does not exist")
    below = fs.get_file_info(pafs.FileSelector(own, recursive=True))
    return sorted(prefix + f.path for f in below if f.type == pafs.FileType.File and extension(f.path) == "zip" and not f.base_name.startswith("."))


def _members(archive: str) -> list[tuple]:
    """(archive, member, error) of the data files in an archive, or its error."""
    fs, path = opened(archive)
    try:
        with fs.open_input_file(path) as file, zipfile.ZipFile(file) as z:
            return [(archive, m, None) for m in z.namelist() if _is_member(m)]
    except NO_ARCHIVE as exc:
        return [(archive, None, f"no ZIP archive: {exc}"[:500])]


def _is_member(name: str) -> bool:
    return not name.endswith("/") and is_data_file(name) and extension(name) in READERS


def archive_cells(archives: DataFrame) -> DataFrame:
    """The records of all data files inside ZIP archives that are given as rows of ``path, content``."""
    return archives.select("path", "content").mapInArrow(_unpack, CELLS)


def _unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path, content in zip(batch.column(0).to_pylist(), batch.column(1)):
            try:
                with zipfile.ZipFile(pa.BufferReader(content.as_buffer())) as z:
                    for member in filter(_is_member, z.namelist()):
                        yield from _member_records(path, z, member)
            except NO_ARCHIVE as exc:
                yield _batch(path, "", [(0, None, None, f"no ZIP archive: {exc}"[:500])])


def _member_records(archive: str, z: zipfile.ZipFile, member: str) -> Iterator[pa.RecordBatch]:
    pending: list[tuple] = []
    try:
        with z.open(member) as raw:
            text = io.TextIOWrapper(raw, encoding="utf-8-sig", newline="")
            found = ((row, None) for row in csv.reader(text) if row) if extension(member) == "csv" else ((None, r) for r in _json_texts(text))
            for i, record in enumerate(found):
                pending.append((i, *record, None))
                if len(pending) >= BATCH_LINES:
                    yield _batch(archive, member, pending)
                    pending = []
    except Exception as exc:
        pending.append((-1, None, None, str(exc)[:500]))
    if pending:
        yield _batch(archive, member, pending)


def _json_texts(text: io.TextIOWrapper) -> Iterator[str]:
    """The records of a stream: JSON lines, the elements of an array, or objects over several lines."""
    start = text.readline(HEAD_CHARS)
    while start and not start.strip():
        start = text.readline(HEAD_CHARS)
    if not start.lstrip().startswith("[") and start.endswith("\n") and _parses(start):
        yield start.strip()
        yield from (line.strip() for line in text if line.strip())
        return
    rules, in_array = Braces(), start.lstrip().startswith("[")
    inside, depth, held, rest = False, -1 if in_array else 0, [], []
    for chunk in itertools.chain([start], iter(lambda: text.read(1 << 20), "")):
        *closed, last = chunk.split("}")
        if closed:
            closed[0], rest = "".join([*rest, closed[0]]), []
        rest.append(last)
        for piece in closed:
            held.append(piece)
            inside, by = rules.moved(piece, inside)
            depth += by
            if rules.closes(inside, depth):
                yield _bare(rules.text(held) + "}", in_array)
                held = []
    left = _bare(rules.text([*held, "".join(rest)]), in_array)
    if left and not (in_array and left == "]"):
        yield left


def _bare(text: str, in_array: bool) -> str:
    """A record without what stands between it and the one before."""
    return re.sub(r"^\s*[\[,]?\s*", "", text).strip() if in_array else text.strip()


def _batch(archive: str, member: str, lines: list[tuple]) -> pa.RecordBatch:
    n = len(lines)
    return pa.RecordBatch.from_arrays([
        pa.array([archive] * n, pa.string()), pa.array([member] * n, pa.string()),
        *[pa.array(c, kind) for c, kind in zip(zip(*lines), (pa.int64(), pa.list_(pa.string()), pa.string(), pa.string()))]], names=["archive", "member", "line_no", "cells", "record", "error"])


def _parses(text: str) -> bool:
    try:
        return isinstance(json.loads(text), dict)
    except ValueError:
        return False


class ArchiveTables(Mapping):
    """The tables of archives by name; each is planned when it is asked for, so that any number of members costs a few numbers each.

    ``facts`` has, by name, the archive, the member, and the header with the counts of the cells or the schema of the records.
    """

    def __init__(self, lines: DataFrame, parsed: DataFrame | None, facts: dict[str, tuple]):
        self._lines, self._parsed, self._facts = lines, parsed, dict(sorted(facts.items()))

    def __iter__(self) -> Iterator[str]:
        return iter(self._facts)

    def __len__(self) -> int:
        return len(self._facts)

    def __getitem__(self, name: str) -> DataFrame:
        archive, member, head, about = self._facts[name]
        if head is None:
            return _typed_variants(self._parsed.where((F.col("file.archive") == archive) & (F.col("file.member") == member)), about)
        return _cells_of(self._lines.where((F.col("archive") == archive) & (F.col("member") == member)), head, *about)

    def together(self, member: str) -> DataFrame:
        """The members of this path in all archives as one table, by column name, typed by the cells of all: one scan."""
        own = {a: (head, about) for a, m, head, about in self._facts.values() if m == member}
        if not own:
            raise KeyError(member)
        if next(iter(own.values()))[0] is None:
            mine = self._parsed.where(F.col("file.member") == member).join(_named(self._parsed, own), F.col("file.archive") == F.col("__archive"), "left_semi")
            return _typed_variants(mine, mine.where("v is not null").agg(F.expr("schema_of_variant_agg(v)").alias("x")).first()["x"])
        rows, counts, heads = 0, {}, {}
        for archive, (head, (n, cells)) in own.items():
            rows += n
            heads.setdefault(tuple(head), []).append(archive)
            for name, found in zip(head, cells):
                counts[name] = [a + b for a, b in zip(counts.get(name, [0] * 4), found)]
        mine = self._lines.where(F.col("member") == member)
        parts = [_cells_of(mine.join(_named(mine, archives), F.col("archive") == F.col("__archive"), "left_semi"), list(head), rows, [counts[c] for c in head])
                 for head, archives in heads.items()]
        return reduce(DataFrame.unionByName, parts)  # a part for each header


def _named(like: DataFrame, archives: Iterable[str]) -> DataFrame:
    """The names of some archives, a short one each."""
    return F.broadcast(local_rows(like.sparkSession, [(a,) for a in archives], "__archive string"))


def _cells_of(lines: DataFrame, head: list[str], rows: int, counts: list) -> DataFrame:
    """The records below a header, typed by the counts of what fits."""
    own = lines.where((F.col("line_no") > 0) & (F.size("cells") <= len(head)))
    return own.select([_typed(null_tokens(F.nullif(F.get("cells", F.lit(i)), F.lit(""))), rows, *counts[i]).alias(c) for i, c in enumerate(head)])


def scan_archive(spark: SparkSession, path: str | DataFrame) -> tuple[ArchiveTables, DataFrame]:
    """Tables inside one or many ZIP archives, and ``(table_name, error)`` rows for the members that could not be read or are
    empty and for the records that do not fit.

    ``path`` is a file, a folder, or rows of ``path, content``. The records are written once to the shared folder, by member,
    so that each table reads only its own part. All members are typed together: the number of jobs does not depend on them.
    The driver keeps a few numbers for each member and column, and plans a table when it is asked for.
    """
    if isinstance(path, DataFrame):
        unpacked = archive_cells(path)
    else:
        spark.dataSource.register(ZipMembers)
        unpacked = spark.read.format("zip_members").load(path)
    stage = fresh_path(spark, "archive")
    unpacked.write.partitionBy("archive", "member").parquet(stage)
    lines = spark.read.schema(CELLS).parquet(stage)
    key = ["archive", "member"]
    about = lines.groupBy(*key).agg(
        F.max(F.when(F.col("line_no") == 0, F.col("cells"))).alias("head"), F.max("error").alias("error"), F.bool_or(F.col("record").isNotNull()).alias("is_json"),
        F.count("*").alias("n")).orderBy(*key).collect()  # a row per member
    several = len({r["archive"] for r in about}) > 1
    name = {(r["archive"], r["member"]): _table_name(r["archive"], r["member"], several) for r in about}
    errors = [(name[r["archive"], r["member"]], r["error"]) for r in about if r["error"]]
    good = [r for r in about if not r["error"]]
    facts: dict[str, tuple] = {}
    parsed = None
    misfits: list[DataFrame] = []
    file = F.element_at(F.split("archive", "/"), -1)
    table_name = (F.when(F.col("member") == "", file).otherwise(F.concat(file, F.lit("/"), F.col("member"))) if several else F.coalesce(F.nullif("member", F.lit("")), file)).alias("table_name")
    csvs, jsons = [r for r in good if r["head"] is not None], [r for r in good if r["is_json"]]
    if csvs:
        heads = {(r["archive"], r["member"]): column_names(r["head"]) for r in csvs}
        widths = local_rows(spark, [(*k, len(h)) for k, h in heads.items()], "archive string, member string, width int")
        body = joined_by_key(lines.where("line_no > 0 and cells is not null"), widths, key)
        fits = body.where(F.size("cells") <= F.col("width"))
        misfits.append(_misfits(body.where(F.size("cells") > F.col("width")).select(table_name, F.array_join("cells", ",").alias("record"), F.size("cells").alias("cells"))))
        # An empty cell is a missing value, as in a file.
        cell = null_tokens(F.nullif(F.col("x"), F.lit("")))
        counts = fits.select(*key, F.posexplode("cells").alias("at", "x")).groupBy(*key, "at").agg(*[c.alias(what) for what, c in _fits(cell).items()])
        types = {(r["archive"], r["member"], r["at"]): [r[what] for what in "nidb"] for r in counts.collect()}  # a row per column
        rows = {(r["archive"], r["member"]): r["count"] for r in fits.groupBy(*key).count().collect()}  # a row per member
        for k, head in heads.items():
            if k not in rows:
                errors.append((name[k], "empty table"))
                continue
            facts[name[k]] = (*k, head, (rows[k], [types.get((*k, i), [0] * 4) for i in range(len(head))]))
    if jsons:
        texts = lines.where("record is not null").select(F.struct(*key).alias("file"), F.col("record").alias("value"))
        parsed = _parsed(texts)
        misfits.append(_misfits(parsed.where("record is not null").select("file.*", "record").select(table_name, "record", F.lit(None).cast("int").alias("cells"))))
        found = parsed.where("v is not null").groupBy("file").agg(F.expr("schema_of_variant_agg(v)").alias("x")).collect()  # a row per member
        schemas = {(r["file"]["archive"], r["file"]["member"]): r["x"] for r in found}
        for r in jsons:
            k = r["archive"], r["member"]
            try:
                if k in schemas:
                    _fields_of(schemas[k])
                    facts[name[k]] = (*k, None, schemas[k])
                else:
                    errors.append((name[k], "empty table"))
            except ValueError as exc:
                errors.append((name[k], str(exc)))
    errors += [(name[r["archive"], r["member"]], "empty table") for r in good if r["head"] is None and not r["is_json"]]
    unread = reduce(DataFrame.unionByName, misfits, local_rows(spark, errors, "table_name string, error string"))
    return ArchiveTables(lines, parsed, facts), unread


def _table_name(archive: str, member: str, several: bool) -> str:
    """The path inside the archive, so that equal base names stay apart."""
    name = archive.rsplit("/", 1)[-1]
    return f"{name}/{member}" if several and member else member or name
