"""Descriptive tables, all in long form."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from studyspark.functions.coerce import is_numeric, numeric_of
from studyspark.operators.order import quantiles
from studyspark.operators.standardise import column_missingness

OTHERS = "(others)"
# So many repeated fingerprints are broadcast (16 MB); more are joined by shuffle.
BROADCAST_PRINTS = 1_000_000


def describe_numeric(df: DataFrame, cols: Sequence[str], mode: str = "exact") -> DataFrame:
    """One row per column with values: n, n_uncoercible, missing_pct, mean, sd, median, iqr, min, max."""
    cols = [c for c in cols if c in df.columns]
    aggs = [F.count("*").alias("_rows")]
    fields = []
    for i, c in enumerate(cols):
        x = numeric_of(df, c)
        aggs += [
            F.count(F.col(c)).alias(f"f{i}"),
            F.count(x).alias(f"n{i}"),
            F.avg(x).alias(f"m{i}"),
            F.stddev_samp(x).alias(f"s{i}"),
            F.min(x).alias(f"l{i}"),
            F.max(x).alias(f"h{i}"),
        ]
        fields.append(
            F.struct(
                F.lit(c).alias("column"),
                F.col(f"n{i}").alias("n"),
                (F.col(f"f{i}") - F.col(f"n{i}")).alias("n_uncoercible"),
                F.round(100.0 * (1 - F.try_divide(f"f{i}", "_rows")), 1).alias("missing_pct"),
                F.round(f"m{i}", 4).alias("mean"),
                F.round(f"s{i}", 4).alias("sd"),
                F.round(f"l{i}", 4).alias("min"),
                F.round(f"h{i}", 4).alias("max"),
            )
        )
    stats = df.agg(*aggs).select(F.inline(F.array(*fields))).where("n > 0")
    q = quantiles(df, cols, [0.25, 0.5, 0.75], mode=mode)
    # both sides have at most one row per column
    return stats.join(F.broadcast(q), F.col("column") == F.col("feature")).select(
        "column",
        "n",
        "n_uncoercible",
        "missing_pct",
        "mean",
        "sd",
        F.round("p50", 4).alias("median"),
        F.round(F.col("p75") - F.col("p25"), 4).alias("iqr"),
        "min",
        "max",
    )


def describe_categorical(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(column, value, n, pct) with NULL as a value; pct of all rows."""
    cols = [c for c in cols if c in df.columns]
    pairs = F.array(
        *[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in cols]
    )
    total = df.agg(F.count("*")).scalar()
    return (
        df.select(F.inline(pairs))
        .groupBy("column", "value")
        .agg(F.count("*").alias("n"))
        .withColumn("pct", F.round(100.0 * F.col("n") / total, 1))
    )


def top_values(df: DataFrame, col: str, top: int = 15) -> DataFrame:
    """(value, n, is_rest): the `top` most frequent values and one row for all others."""
    counts = df.groupBy(F.col(col).cast("string").alias("value")).agg(F.count("*").alias("n"))
    head = counts.orderBy(F.desc("n"), F.asc_nulls_last("value")).limit(top)
    total = df.agg(F.count("*")).scalar()
    rest = head.agg((total - F.sum("n")).alias("n")).where("n > 0").select(
        F.lit(OTHERS).alias("value"), "n"
    )
    return head.withColumn("is_rest", F.lit(False)).unionByName(
        rest.withColumn("is_rest", F.lit(True))
    )


def profile_columns(df: DataFrame, top: int | None = None) -> DataFrame:
    """(column, dtype, kind, missing_share), most missing first."""
    shares = column_missingness(df)
    dtype, kind = F.when(F.lit(False), F.lit("")), F.when(F.lit(False), F.lit(""))
    for f in df.schema:
        dtype = dtype.when(F.col("column") == f.name, F.lit(f.dataType.simpleString()))
        label = "numeric" if is_numeric(f.dataType) else "categorical"
        kind = kind.when(F.col("column") == f.name, F.lit(label))
    out = shares.select("column", dtype.alias("dtype"), kind.alias("kind"), "missing_share")
    out = out.orderBy(F.desc("missing_share"), "column")
    return out if top is None else out.limit(top)


def profile_totals(df: DataFrame) -> DataFrame:
    """One row: n_rows, n_cols, duplicate_rows (rows beyond the first of each exact copy).

    Rows are told apart by 64-bit fingerprints, so a few bytes of each are shuffled; only rows whose
    fingerprint repeats are compared whole, so the count is exact.
    """
    columns = [F.col(f"`{c}`") for c in df.columns]
    # hashes pass over nulls, so which cells are null is hashed too
    print_ = F.xxhash64(*[x for c in columns for x in (c, c.isNull())]) if columns else F.lit(0)
    counts = df.select(print_.alias("_h")).groupBy("_h").agg(F.count("*").alias("_n"))
    n_rows, repeated = counts.agg(F.coalesce(F.sum("_n"), F.lit(0)), F.count(F.when(F.col("_n") > 1, 1))).first()
    extra = 0
    if repeated:
        again = counts.where("_n > 1").select("_h")
        few = F.broadcast(again) if repeated <= BROADCAST_PRINTS else again
        names = [f"_c{i}" for i in range(len(columns))]
        rows = df.select(print_.alias("_h"), *[c.alias(n) for c, n in zip(columns, names)])
        copies = rows.join(few, "_h", "left_semi").groupBy(*names).agg(F.count("*").alias("_n"))
        extra = copies.agg(F.coalesce(F.sum(F.col("_n") - 1), F.lit(0))).first()[0]
    row = (n_rows, len(df.columns), extra)
    return df.sparkSession.createDataFrame([row], "n_rows bigint, n_cols bigint, duplicate_rows bigint")


def crosstab(
    df: DataFrame, group: str, outcome: str, values: Sequence | None = None
) -> DataFrame:
    """Counts per (group, outcome), NULL kept; wide with one column per listed value."""
    if values is None:
        return df.groupBy(group, outcome).agg(F.count("*").alias("n"))
    return df.groupBy(group).agg(
        *[
            F.count(F.when(F.col(outcome).eqNullSafe(F.lit(v)), 1)).alias(str(v))
            for v in values
        ]
    )


def positive_share(df: DataFrame, group: str, outcome: str, positive=None) -> DataFrame:
    """(group, n, positive_share) for a two-valued outcome; the larger value is the positive one."""
    if positive is None:
        found = df.select(outcome).where(F.col(outcome).isNotNull()).distinct().limit(3).collect()
        if len(found) != 2:
            raise ValueError(f"{outcome} does not have exactly two values")
        positive = max(r[0] for r in found)
    hit = F.count(F.when(F.col(outcome) == F.lit(positive), 1))
    return df.groupBy(group).agg(
        F.count("*").alias("n"), F.round(hit / F.count("*"), 4).alias("positive_share")
    )


def rows_per_month(df: DataFrame, time: str, first: int = 12) -> DataFrame:
    return (
        df.where(F.col(time).isNotNull())
        .groupBy(F.date_format(time, "yyyy-MM").alias("month"))
        .agg(F.count("*").alias("n"))
        .orderBy("month")
        .limit(first)
    )


def condition_stats(df: DataFrame, condition: str, outcome: str) -> DataFrame:
    """(condition, mean, sd, n) of one outcome, conditions without values left out."""
    x = numeric_of(df, outcome)
    return (
        df.where(F.col(condition).isNotNull())
        .groupBy(condition)
        .agg(
            F.round(F.avg(x), 4).alias("mean"),
            F.round(F.stddev_samp(x), 4).alias("sd"),
            F.count(x).alias("n"),
        )
        .where("n > 0")
    )


def conditions(df: DataFrame, condition: str) -> DataFrame:
    return df.select(condition).where(F.col(condition).isNotNull()).distinct().orderBy(condition)
