"""Names, types, time axes, row concatenation and column selection."""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from studyspark.functions.coerce import (
    TIME_FORMATS,
    is_numeric,
    numeric_of,
    text_columns,
    timestamp_text,
)
from studyspark.operators.keyed import attach
from studyspark.operators.order import quantiles

MAX_NAME = 64
DAYS_PER_MONTH = 30.44


# Text of a whole number, with an optional sign.
WHOLE_TEXT = r"^\s*[+-]?\d+\s*$"
# Name parts that mark a column as not a mean of interest, and as not plain.
NOT_A_MEAN = ("ratio", "asi", "sample", "%cv", "_cv")
NOT_PLAIN = ("%cv", "unnamed", "sample")


def normal_name(name: str, style: str = "strict") -> str:
    text = name.strip()
    if style == "loose":
        return re.sub(r"[^a-zA-Z0-9_]+", "_", text).lower()[:MAX_NAME]
    return re.sub(r"[^a-z0-9]+", "_", text.lower()).strip("_")[:MAX_NAME]


def normal_names(names: Sequence[str], style: str = "strict") -> list[str]:
    """Normalised, unique names; the loose style leaves clashes to the caller."""
    base = [normal_name(n, style) for n in names]
    if style == "loose":
        return base
    base = [b or f"col_{i}" for i, b in enumerate(base)]
    taken: set[str] = set()
    out = []
    for b in base:
        name, k = b, 0
        while name in taken:
            k += 1
            name = f"{b}_{k}"
        taken.add(name)
        out.append(name)
    return out


def normalise_columns(df: DataFrame, style: str = "strict") -> DataFrame:
    return df.toDF(*normal_names(df.columns, style))


def parse_shares(df: DataFrame, formats: Sequence[tuple[str, str]] = TIME_FORMATS) -> DataFrame:
    """Per text column: share of all rows that read as a number and as a time."""
    cols = text_columns(df)
    aggs = []
    for i, c in enumerate(cols):
        as_num = numeric_of(df, c).isNotNull().cast("int")
        as_time = timestamp_text(F.col(c), formats).isNotNull().cast("int")
        filled = F.col(c).isNotNull()
        as_bad = (filled & numeric_of(df, c).isNull()).cast("int")
        text = F.col(c).cast("string")
        whole = filled & text.rlike(WHOLE_TEXT)
        fits = whole & F.trim(text).try_cast("bigint").isNotNull()
        number = numeric_of(df, c).isNotNull()
        aggs += [
            F.avg(as_num).alias(f"n{i}"),
            F.avg(as_time).alias(f"t{i}"),
            F.sum(as_bad).alias(f"b{i}"),
            F.sum((number & ~whole).cast("int")).alias(f"f{i}"),
            F.sum((whole & ~fits).cast("int")).alias(f"w{i}"),
        ]
    rows = [
        F.struct(
            F.lit(c).alias("column"),
            F.col(f"n{i}").alias("numeric_share"),
            F.col(f"t{i}").alias("time_share"),
            F.col(f"b{i}").alias("non_numeric"),
            F.col(f"f{i}").alias("fractional"),
            F.col(f"w{i}").alias("too_wide"),
        )
        for i, c in enumerate(cols)
    ]
    if not cols:
        schema = (
            "column string, numeric_share double, time_share double, non_numeric bigint, "
            "fractional bigint, too_wide bigint"
        )
        return df.sparkSession.createDataFrame([], schema)
    return df.agg(*aggs).select(F.inline(F.array(*rows)))


def infer_types(
    df: DataFrame,
    numeric_share: float = 0.7,
    time_share: float = 0.5,
    formats: Sequence[tuple[str, str]] = TIME_FORMATS,
    keep: Sequence[str] = (),
) -> DataFrame:
    """Cast text columns that mostly read as numbers or times (one aggregate decides all).

    A column whose every filled cell is a number is numeric however sparse it is. Whole numbers
    become BIGINT; `keep` names columns that stay text. A column of whole numbers of which some exceed it stays text, as a DOUBLE would
    merge neighbours. Any other numeric column is DOUBLE.
    """
    casts: dict[str, Column] = {}
    for row in parse_shares(df.drop(*keep), formats).collect():
        c = row["column"]
        if row["numeric_share"] is None:
            continue
        whole = row["non_numeric"] == 0 and row["numeric_share"] > 0
        if whole or row["numeric_share"] > numeric_share:
            if row["fractional"]:
                casts[c] = numeric_of(df, c)
            elif not row["too_wide"]:
                text = F.col(c).cast("string")
                casts[c] = F.when(text.rlike(WHOLE_TEXT), F.trim(text).try_cast("bigint"))
        elif row["time_share"] > time_share:
            casts[c] = timestamp_text(F.col(c), formats)
    return df.withColumns(casts) if casts else df


def time_unit(
    df: DataFrame, col: str, share: float = 0.5, ms_above: float = 1e10, s_above: float = 1e6
) -> str:
    """'ms', 's' or 'text', from the parse share and the median."""
    dtype = df.schema[col].dataType
    if isinstance(dtype, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return "native"
    x = numeric_of(df, col)
    rows, n, over_ms, over_s = df.agg(
        F.count("*"),
        F.count(x),
        F.count(F.when(x > ms_above, 1)),
        F.count(F.when(x > s_above, 1)),
    ).first()
    if not rows or n / rows <= share:
        return "text"

    def median_above(limit: float, over: int) -> bool:
        # counts settle on which side both middle values lie; only a limit between them needs the
        # median itself
        if n - over <= (n - 1) // 2:
            return True
        if n - over >= n // 2 + 1:
            return False
        return quantiles(df, [col], [0.5]).first()["p50"] > limit

    return "ms" if median_above(ms_above, over_ms) else "s" if median_above(s_above, over_s) else "text"


def parse_time(
    df: DataFrame,
    col: str,
    share: float = 0.5,
    ms_above: float = 1e10,
    s_above: float = 1e6,
    formats: Sequence[tuple[str, str]] = TIME_FORMATS,
) -> Column:
    """TIMESTAMP from epoch ms, epoch s or text; the defaults and (0.7, 1e12, 1e9) are in use."""
    unit = time_unit(df, col, share, ms_above, s_above)
    if unit == "native":
        return F.col(col).cast("timestamp")
    if unit == "ms":
        return F.timestamp_micros((numeric_of(df, col) * 1000).cast("bigint"))
    if unit == "s":
        return F.timestamp_micros((numeric_of(df, col) * 1000000).cast("bigint"))
    return timestamp_text(F.col(col).cast("string"), formats)


def months_since_baseline(
    df: DataFrame,
    entity: str,
    time: str,
    output: str = "months_since_baseline",
    **parse,
) -> DataFrame:
    """Months (30.44 days) since the first time of the entity; NULL entity or time gives NULL."""
    rows = df.drop(output).withColumn("_t", parse_time(df, time, **parse))
    first = (
        rows.where(F.col(entity).isNotNull()).groupBy(entity).agg(F.min("_t").alias("_baseline"))
    )
    micros = F.timestamp_diff("MICROSECOND", F.col("_baseline"), F.col("_t"))
    months = F.round(micros / 1e6 / 86400 / DAYS_PER_MONTH, 2)
    return (
        attach(rows, first, [entity]).withColumn(output, months).drop("_t", "_baseline")
    )


def _common_type(types: list[T.DataType]) -> T.DataType:
    if all(t == types[0] for t in types):
        return types[0]
    if all(is_numeric(t) for t in types):
        ints = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
        return T.LongType() if all(isinstance(t, ints) for t in types) else T.DoubleType()
    times = (T.TimestampType, T.TimestampNTZType, T.DateType)
    if all(isinstance(t, times) for t in types):
        return T.TimestampType()
    return T.StringType()


def concat_rows(frames: Sequence[DataFrame]) -> DataFrame:
    """All rows, all columns (first-seen order); differing types meet in a common one."""
    if not frames:
        raise ValueError("concat_rows needs at least one DataFrame")
    seen: dict[str, list[T.DataType]] = {}
    for df in frames:
        for f in df.schema:
            seen.setdefault(f.name, []).append(f.dataType)
    target = {name: _common_type(types) for name, types in seen.items()}
    cast = [
        df.select(*[F.col(f"`{c}`").cast(target[c]).alias(c) for c in df.columns]) for df in frames
    ]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), cast)


def best_numeric_columns(df: DataFrame, limit: int | None = None) -> list[str]:
    """Columns worth analysing: means first, else numeric without ratio/sample noise."""
    names = [f.name for f in df.schema if is_numeric(f.dataType)]
    low = {n: n.lower() for n in names}
    means = [n for n in names if "mean" in low[n] and not any(w in low[n] for w in NOT_A_MEAN)]
    plain = [n for n in names if not any(w in low[n] for w in NOT_PLAIN)]
    return (means or plain or names)[:limit]


def categorical_candidates(df: DataFrame, below: int = 50, limit: int | None = None) -> list[str]:
    """Text columns with fewer than `below` distinct values."""
    cols = text_columns(df)
    if not cols:
        return []
    sketch = df.agg(*[F.approx_count_distinct(c, 0.02).alias(c) for c in cols]).first()
    near = [c for c in cols if sketch[c] < 2 * below]
    if not near:
        return []
    # the exact count is taken only where the sketch says it is small
    exact = df.agg(*[F.size(F.collect_set(c)).alias(c) for c in near]).first()
    return [c for c in near if exact[c] < below][:limit]


def is_categorical(df: DataFrame, col: str, below: int = 15) -> bool:
    dtype = df.schema[col].dataType
    if isinstance(dtype, T.StringType):
        return True
    return df.select(col).where(F.col(col).isNotNull()).distinct().limit(below).count() < below


def drop_columns(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """Drop by name in any spelling; unknown names are ignored."""
    return df.drop(*[normal_name(n, "loose") for n in names if n.strip()])


def column_missingness(df: DataFrame, exclude: Sequence[str] = ()) -> DataFrame:
    """(column, missing_share) for every column, in one aggregate."""
    cols = [c for c in df.columns if c not in exclude]
    wide = df.agg(
        *[F.avg(F.col(f"`{c}`").isNull().cast("int")).alias(f"m{i}") for i, c in enumerate(cols)]
    )
    rows = [
        F.struct(F.lit(c).alias("column"), F.col(f"m{i}").alias("missing_share"))
        for i, c in enumerate(cols)
    ]
    return wide.select(F.inline(F.array(*rows)))


def drop_sparse_columns(df: DataFrame, threshold: float = 0.8) -> tuple[DataFrame, list[str]]:
    """Drop columns missing in at least `threshold` of the rows; also return their names."""
    shares = {r["column"]: r["missing_share"] for r in column_missingness(df).collect()}
    sparse = [c for c in df.columns if shares[c] is not None and shares[c] >= threshold]
    return df.drop(*sparse), sparse


def project_roles(
    df: DataFrame, mapping: dict[str, str | None], defaults: dict[str, Column]
) -> DataFrame:
    """Rename mapped columns to their roles; unmapped roles take the default column."""
    cols = [
        (F.col(mapping[role]) if mapping.get(role) else default).alias(role)
        for role, default in defaults.items()
    ]
    return df.select(*cols)
