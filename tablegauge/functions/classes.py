"""The four column classes, decided from the schema alone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablegauge.functions.nulls import quoted

INTEGRALS = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
DATETIMES = (T.DateType, T.TimestampType, T.TimestampNTZType)

# Bytes per value of the fixed-width types.
WIDTHS = {
    T.BooleanType: 1, T.ByteType: 1, T.ShortType: 2, T.IntegerType: 4, T.LongType: 8,
    T.FloatType: 4, T.DoubleType: 8, T.DateType: 4, T.TimestampType: 8, T.TimestampNTZType: 8,
}


_NOT_FLAT = (T.ArrayType, T.MapType, T.StructType, T.BinaryType, T.VariantType)


def dtype_class(dtype: T.DataType) -> str:
    if isinstance(dtype, T.BooleanType):
        return "boolean"
    if isinstance(dtype, DATETIMES):
        return "datetime"
    if isinstance(dtype, T.NumericType):
        return "numeric"
    return "categorical"


def columns_of(df: DataFrame, cls: str) -> list[str]:
    return [f.name for f in df.schema if dtype_class(f.dataType) == cls]


def select_by_class(df: DataFrame, cls: str) -> DataFrame:
    """Only the columns of one class."""
    return df.select([quoted(c) for c in columns_of(df, cls)])


def text_form(df: DataFrame) -> DataFrame:
    """Nested and binary columns as text, so that every column can be grouped and compared."""
    if not any(isinstance(f.dataType, _NOT_FLAT) for f in df.schema):
        return df
    out = []
    for f in df.schema:
        c = quoted(f.name)
        if isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType)):
            if isinstance(f.dataType, T.MapType):
                c = F.array_sort(F.map_entries(c))
                c = F.when(c.isNotNull(), F.to_json(F.struct(c.alias("entries"))))
            elif isinstance(f.dataType, T.ArrayType):
                c = F.when(c.isNotNull(), F.to_json(c))
            else:
                c = F.to_json(c, {"ignoreNullFields": "false"})
        elif isinstance(f.dataType, T.BinaryType):
            c = F.base64(c)
        elif isinstance(f.dataType, T.VariantType):
            c = c.cast("string")
        out.append(c.alias(f.name))
    return df.select(out)
