"""One null model: NaN and NULL are both "missing", and output carries no NaN or infinity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

FLOATS = (T.FloatType, T.DoubleType)


def sql_name(name: str) -> str:
    """The name as SQL text, whatever dots or blanks it holds."""
    return "`" + name.replace("`", "``") + "`"


def quoted(name: str) -> Column:
    """The column of that exact name."""
    return F.col(sql_name(name))


def normalize_nulls(df: DataFrame) -> DataFrame:
    """NaN becomes NULL and -0.0 becomes 0.0 in every float column; other columns pass through."""
    if not any(isinstance(f.dataType, FLOATS) for f in df.schema):
        return df
    out = []
    for f in df.schema:
        c = quoted(f.name)
        if isinstance(f.dataType, FLOATS):
            c = F.when(~F.isnan(c), c + F.lit(0.0).cast(f.dataType)).alias(f.name)
        out.append(c)
    return df.select(out)


def number(name: str) -> Column:
    """A numeric column as double, NaN as NULL."""
    x = quoted(name).cast("double")
    return F.when(~F.isnan(x), x)


def finite(c: Column) -> Column:
    """NaN and both infinities become NULL."""
    return F.when(~F.isnan(c) & (F.abs(c) != F.lit(float("inf"))), c)


def _safe(c: Column, dtype: T.DataType) -> Column:
    if isinstance(dtype, FLOATS):
        return finite(c)
    if isinstance(dtype, T.ArrayType) and _has_float(dtype.elementType):
        return F.transform(c, lambda x: _safe(x, dtype.elementType))
    if isinstance(dtype, T.MapType) and _has_float(dtype.valueType):
        return F.transform_values(c, lambda _, v: _safe(v, dtype.valueType))
    if isinstance(dtype, T.StructType) and _has_float(dtype):
        fields = [_safe(c.getField(f.name), f.dataType).alias(f.name) for f in dtype]
        return F.when(c.isNotNull(), F.struct(*fields))
    return c


def _has_float(dtype: T.DataType) -> bool:
    if isinstance(dtype, T.ArrayType):
        return _has_float(dtype.elementType)
    if isinstance(dtype, T.MapType):
        return _has_float(dtype.valueType)
    if isinstance(dtype, T.StructType):
        return any(_has_float(f.dataType) for f in dtype)
    return isinstance(dtype, FLOATS)


def json_safe_values(df: DataFrame) -> DataFrame:
    """NaN and infinities become NULL at every depth of nested columns."""
    return df.select([_safe(quoted(f.name), f.dataType).alias(f.name) for f in df.schema])
