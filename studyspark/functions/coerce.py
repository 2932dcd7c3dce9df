"""Lenient casts: a bad token becomes NULL, and NaN becomes NULL."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

NUMERIC_TEXT = r"^\s*[+-]?((\d+\.?\d*|\.\d+)([eE][+-]?\d+)?|[iI][nN][fF]([iI][nN][iI][tT][yY])?)\s*$"
# Shape of the text and the format to read it with. The shape decides first, because a failed parse
# costs far more than a failed match.
TIME_FORMATS = (
    (r"^\d{4}-\d{2}-\d{2}$", "yyyy-MM-dd"),
    (r"^\d{4}-\d{2}-\d{2} \d{2}:\d{2}$", "yyyy-MM-dd HH:mm"),
    (r"^\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}$", "yyyy-MM-dd HH:mm:ss"),
    (r"^\d{4}/\d{1,2}/\d{1,2}$", "yyyy/M/d"),
    (r"^\d{1,2}/\d{1,2}/\d{4}$", "M/d/yyyy"),
    (r"^\d{1,2}/\d{1,2}/\d{4} \d{2}:\d{2}:\d{2}$", "M/d/yyyy HH:mm:ss"),
    (r"^\d{2}-[A-Za-z]{3}-\d{4}$", "dd-MMM-yyyy"),
)
ISO_TEXT = r"^\d{4}-\d{2}(-\d{2}([T ]\d{2}:\d{2}(:\d{2}(\.\d+)?)?\s*(Z|[+-]\d{2}:?\d{2})?)?)?$"


def nan_to_null(col: Column) -> Column:
    return F.when(~F.isnan(col), col)


def numeric(col: Column, dtype: T.DataType) -> Column:
    """`col` as DOUBLE; text that is not a plain number becomes NULL."""
    if isinstance(dtype, (T.DoubleType, T.FloatType)):
        return nan_to_null(col.cast("double"))
    if isinstance(dtype, (T.NumericType, T.BooleanType)):
        return col.cast("double")
    if isinstance(dtype, T.StringType):
        return F.when(col.rlike(NUMERIC_TEXT), F.trim(col).try_cast("double"))
    return F.lit(None).cast("double")


def numeric_of(df: DataFrame, name: str) -> Column:
    return numeric(F.col(name), df.schema[name].dataType)


def is_numeric(dtype: T.DataType) -> bool:
    return isinstance(dtype, T.NumericType)


def numeric_columns(df: DataFrame, limit: int | None = None) -> list[str]:
    """Numeric columns in schema order, optionally the first `limit` of them."""
    names = [f.name for f in df.schema if is_numeric(f.dataType)]
    return names if limit is None else names[:limit]


def text_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]


def nulls_for_nans(df: DataFrame) -> DataFrame:
    """Map NaN to NULL once, so every later operator sees NULL only."""
    floats = {
        f.name: nan_to_null(F.col(f.name))
        for f in df.schema
        if isinstance(f.dataType, (T.DoubleType, T.FloatType))
    }
    return df.withColumns(floats) if floats else df


def timestamp_text(
    col: Column, formats: Sequence[tuple[str, str]] = TIME_FORMATS
) -> Column:
    """TIMESTAMP of text in a known shape, ISO text included; anything else is NULL."""
    text = F.trim(col)
    out = F.when(F.lit(False), F.lit(None).cast("timestamp"))
    for shape, fmt in formats:
        out = out.when(text.rlike(shape), F.try_to_timestamp(text, F.lit(fmt)))
    return out.when(text.rlike(ISO_TEXT), text.try_cast("timestamp"))


def blank(col: Column) -> Column:
    """NULL or whitespace only."""
    return F.coalesce(F.trim(col.cast("string")), F.lit("")) == ""
