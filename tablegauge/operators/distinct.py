"""Distinct counts and most frequent values of many columns in one pass for numbers and one for text.

Where values are counted, columns are turned into ``(column_name, value)`` rows by type family, so integers, floats and
text each travel in their own type, and one grouped count serves all columns of a family. Text
longer than ``LONG_TEXT`` bytes travels as its SHA-256 instead. Numbers of which only the different ones are wanted
travel as 64-bit integers (see ``collapse``).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablegauge.functions.classes import INTEGRALS, text_form
from tablegauge.functions.nulls import quoted, sql_name
from tablegauge.functions.session import local_rows
from tablegauge.operators.collapse import distinct_numbers

LONG_TEXT = 64


def _family(dtype: T.DataType) -> str:
    if isinstance(dtype, INTEGRALS + (T.BooleanType, T.DateType, T.TimestampType, T.TimestampNTZType)):
        return "bigint"
    if isinstance(dtype, (T.FloatType, T.DoubleType)):
        return "double"
    return "string"


def _as_long(x: str, dtype: T.DataType) -> str:
    """A fixed-width value as one integer, as SQL text."""
    if isinstance(dtype, T.DateType):
        return f"cast(unix_date({x}) as bigint)"
    if isinstance(dtype, T.TimestampNTZType):
        # From its parts, so that the session zone is not used.
        return (f"unix_date(cast({x} as date)) * 86400000000L + (hour({x}) * 3600 + minute({x}) * 60) * 1000000L "
                f"+ cast(extract(second from {x}) * 1000000 as bigint)")
    if isinstance(dtype, T.TimestampType):
        return f"unix_micros({x})"
    return f"cast({x} as bigint)"


_KEY = "case when octet_length({x}) <= " + str(LONG_TEXT) + " then {x} else concat('sha256:', sha2({x}, 256)) end"


def text_key(c: Column) -> Column:
    """The text itself when short, else a fixed-length digest that stands for it."""
    return F.when(F.octet_length(c) <= LONG_TEXT, c).otherwise(F.concat(F.lit("sha256:"), F.sha2(c, 256)))


def long_values(df: DataFrame, family: str, names: list[str] | None = None) -> DataFrame | None:
    """``(column_name, value)`` rows of the columns of one family, nulls left out."""
    df = text_form(df)
    chosen = [f for f in df.schema if _family(f.dataType) == family and (names is None or f.name in names)]
    if not chosen:
        return None
    cells = []
    for f in chosen:
        x = sql_name(f.name)
        if family == "bigint":
            value = _as_long(x, f.dataType)
        elif family == "double":
            value = f"cast({x} as double)"
        else:
            value = _KEY.format(x=x if isinstance(f.dataType, T.StringType) else f"cast({x} as string)")
        cells.append(f"{value} as {x}")
    wide = df.selectExpr(*cells)
    return wide.unpivot([], [quoted(f.name) for f in chosen], "column_name", "value").filter("value is not null")


def frequency_table(df: DataFrame, names: list[str] | None = None) -> DataFrame:
    """``(column_name, value STRING, freq)`` for every non-null value of the columns."""
    parts = []
    for family in ("bigint", "double", "string"):
        rows = long_values(df, family, names)
        if rows is not None:
            counted = rows.groupBy("column_name", "value").agg(F.count("*").alias("freq"))
            parts.append(counted.withColumn("value", F.col("value").cast("string")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _number_parts(df: DataFrame, names: list[str] | None, values: int | None) -> DataFrame | None:
    """``(column_name, n_distinct)`` of the columns that are numbers, dates or flags."""
    df = text_form(df)
    chosen = [f for f in df.schema if _family(f.dataType) != "string" and (names is None or f.name in names)]
    if not chosen:
        return None
    cells = [(_as_long(sql_name(f.name), f.dataType) if _family(f.dataType) == "bigint" else f"cast({sql_name(f.name)} as double)") + f" as `{i}`"
             for i, f in enumerate(chosen)]
    places = local_rows(df.sparkSession, [(i, f.name) for i, f in enumerate(chosen)], "a long, column_name string")
    counted = distinct_numbers(df.selectExpr(*cells), values)
    return counted.join(F.broadcast(places), "a").select("column_name", "n_distinct")  # a row per column


def distinct_parts(df: DataFrame, names: list[str] | None = None, values: int | None = None) -> list[DataFrame]:
    """``(column_name, n_distinct)`` of the numbers and of the text; a column without any value has no row.

    ``values`` is how many the columns that are no text hold together, if that is known.
    """
    texts = long_values(df, "string", names)
    found = [_number_parts(df, names, values)]
    if texts is not None:
        found.append(texts.distinct().groupBy("column_name").agg(F.count("*").alias("n_distinct")))
    return [part for part in found if part is not None]


def distinct_counts(df: DataFrame, names: list[str] | None = None) -> DataFrame:
    """``(column_name, n_distinct)`` of all families together."""
    return reduce(DataFrame.unionByName, distinct_parts(df, names))


def approx_distinct_counts(df: DataFrame, names: list[str] | None = None) -> DataFrame:
    """The same shape from sketches: no shuffle of values, about 2 % relative error."""
    names = names or df.columns
    flat = text_form(df)
    sketch = [F.approx_count_distinct(quoted(c), 0.02).alias(c) for c in names]
    return (
        flat.agg(*sketch)
        .unpivot([], [quoted(c) for c in names], "column_name", "n_distinct")
        .filter("n_distinct > 0")
    )


def text_frequencies(df: DataFrame, names: list[str]) -> DataFrame:
    """``(column_name, value, freq)`` of text columns, the value being its key."""
    return long_values(df, "string", names).groupBy("column_name", "value").agg(F.count("*").alias("freq"))


def text_tops(freq: DataFrame) -> DataFrame:
    """``(column_name, n_distinct, top_freq, top_key, low, high)`` of ``text_frequencies``, ties by smallest key."""
    best = F.min(F.struct((-F.col("freq")).alias("neg"), F.col("value").alias("value")))
    return (
        freq.groupBy("column_name")
        .agg(F.count("*").alias("n_distinct"), best.alias("best"), F.min("value").alias("low"), F.max("value").alias("high"))
        .select("column_name", "n_distinct", (-F.col("best.neg")).alias("top_freq"),
                F.col("best.value").alias("top_key"), "low", "high")
    )


def smallest_top_text(df: DataFrame, name: str, top_freq: int) -> DataFrame:
    """``(top_value)`` of a column of long texts: the smallest text among the most frequent.

    Keys are digests there. Equal texts become one row, which keeps the text, before anything is shuffled, so
    no task meets all rows of a frequent one. When every text occurs once, all of them win.
    """
    flat = text_form(df.select(quoted(name).alias("v"))).dropna()
    if top_freq > 1:
        counted = flat.groupBy(text_key(F.col("v")).alias("k")).agg(F.count("*").alias("freq"), F.min("v").alias("v"))
        flat = counted.filter(F.col("freq") == top_freq)
    return flat.agg(F.min("v").alias("top_value"))
