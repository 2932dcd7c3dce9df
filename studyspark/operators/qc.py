"""Quality control: every row keeps its place and gets reasons and a keep flag."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from studyspark.functions.coerce import blank, numeric_of
from studyspark.operators.keyed import attach
from studyspark.operators.order import quantiles
from studyspark.operators.standardise import column_missingness

REASON, KEEP = "qc_reason", "qc_keep"
MIN_VALUES = 10


def _reasons(
    df: DataFrame, checks: Sequence[Column], clean: str = "", keep_type: str = "boolean"
) -> DataFrame:
    """Join the non-null reasons in order; `clean` stands for none."""
    joined = F.concat_ws(",", *checks) if checks else F.lit("")
    reason = F.coalesce(F.nullif(joined, F.lit("")), F.lit(clean)) if clean else joined
    return df.withColumn(REASON, reason).withColumn(
        KEEP, (F.col(REASON) == clean).cast(keep_type)
    )


def _fresh(df: DataFrame) -> DataFrame:
    return df.drop(REASON, KEEP)


def outlier_bounds(
    df: DataFrame, cols: Sequence[str], method: str = "iqr", threshold: float = 3.0
) -> DataFrame:
    """(feature, n, low, high): outliers lie outside; NULL bounds mean the column is not checked."""
    moments = [
        F.struct(
            F.lit(c).alias("feature"),
            F.col(f"n{i}").alias("n"),
            F.col(f"m{i}").alias("m"),
            F.col(f"s{i}").alias("s"),
        )
        for i, c in enumerate(cols)
    ]
    aggs = []
    for i, c in enumerate(cols):
        x = numeric_of(df, c)
        mean, sd = (F.avg(x), F.stddev_samp(x)) if method == "zscore" else (F.lit(None), F.lit(None))
        aggs += [
            F.count(x).alias(f"n{i}"),
            mean.cast("double").alias(f"m{i}"),
            sd.cast("double").alias(f"s{i}"),
        ]
    stats = df.agg(*aggs).select(F.inline(F.array(*moments)))
    enough = F.col("n") >= MIN_VALUES
    if method == "zscore":
        usable = enough & (F.col("s") > 0)
        return stats.select(
            "feature",
            "n",
            F.when(usable, F.col("m") - threshold * F.col("s")).alias("low"),
            F.when(usable, F.col("m") + threshold * F.col("s")).alias("high"),
        )
    q = quantiles(df, cols, [0.25, 0.75])
    span = threshold * (F.col("p75") - F.col("p25"))
    return stats.join(F.broadcast(q), "feature").select(
        "feature",
        "n",
        F.when(enough, F.col("p25") - span).alias("low"),
        F.when(enough, F.col("p75") + span).alias("high"),
    )


def _first_row_flag(
    df: DataFrame, keys: Sequence[str], order: Sequence[str]
) -> tuple[DataFrame, Column]:
    """Attach the first order value of every repeated key; rows that differ from it are repeats."""
    rank = F.col(order[0]) if len(order) == 1 else F.struct(*order)
    first = (
        df.groupBy(*keys)
        .agg(F.min(rank).alias("_first"), F.count("*").alias("_n"))
        .where("_n > 1")
        .drop("_n")
    )
    out = attach(df, first, keys)
    return out, F.col("_first").isNotNull() & ~rank.eqNullSafe(F.col("_first"))


def run_qc(
    df: DataFrame,
    required: Sequence[str] = (),
    row_missingness: float = 0.8,
    duplicate_keys: Sequence[str] = (),
    order_cols: Sequence[str] = (),
    outlier_method: str = "iqr",
    outlier_threshold: float = 3.0,
    numeric_cols: Sequence[str] = (),
) -> DataFrame:
    """Add qc_reason and qc_keep. Reason order: required, row missingness, duplicates, outliers.

    `order_cols` must identify a row; the first row of a repeated key is kept. Outlier bounds (two
    numbers per column) are computed first and enter the row pass as literals.
    """
    df = _fresh(df)
    names = df.columns
    checks: list[Column] = []
    for c in required:
        if c in names:
            checks.append(F.when(F.col(c).isNull(), F.lit(f"null_required:{c}")))
        else:
            checks.append(F.lit(f"missing_required_col:{c}"))
    missing = sum((F.col(f"`{c}`").isNull().cast("int") for c in names), F.lit(0))
    checks.append(F.when(missing / len(names) > row_missingness, F.lit("high_row_missingness")))
    keys = [k for k in duplicate_keys if k in names]
    rows = df
    found: dict[str, Column] = {}
    if keys:
        if not order_cols:
            raise ValueError("duplicate_keys need order_cols that identify a row")
        rows, repeat = _first_row_flag(df, keys, list(order_cols))
        checks.append(F.when(repeat, F.lit("duplicate_key")))
    cols = [c for c in numeric_cols if c in names]
    if cols:
        for b in outlier_bounds(df, cols, outlier_method, outlier_threshold).collect():
            if b["low"] is not None:
                x = numeric_of(df, b["feature"])
                outside = (x < b["low"]) | (x > b["high"])
                found[b["feature"]] = F.when(outside, F.lit(f"outlier:{b['feature']}"))
        checks += [found[c] for c in cols if c in found]
    return _reasons(rows, checks).select(*names, REASON, KEEP)


def kept_rows(df: DataFrame) -> DataFrame:
    return df.where(F.col(KEEP).cast("boolean")).drop(REASON, KEEP)


def qc_totals(df: DataFrame) -> DataFrame:
    """One row: total, kept, removed, kept_pct."""
    kept = F.coalesce(F.sum(F.col(KEEP).cast("int")), F.lit(0)).cast("bigint")
    return df.agg(F.count("*").alias("total"), kept.alias("kept")).select(
        "total",
        "kept",
        (F.col("total") - F.col("kept")).alias("removed"),
        F.coalesce(F.round(100.0 * F.try_divide("kept", "total"), 1), F.lit(0.0)).alias("kept_pct"),
    )


def reason_counts(df: DataFrame, top: int | None = None) -> DataFrame:
    """(reason, n_removed) over flagged rows, most frequent first."""
    out = (
        df.where(~F.col(KEEP).cast("boolean"))
        .select(F.explode(F.split(REASON, ",")).alias("reason"))
        .select(F.trim("reason").alias("reason"))
        .where("reason <> ''")
        .groupBy("reason")
        .agg(F.count("*").alias("n_removed"))
        .orderBy(F.desc("n_removed"), "reason")
    )
    return out if top is None else out.limit(top)


def missing_columns(
    df: DataFrame, above: float | None = 0.2, top: int = 10
) -> DataFrame:
    """(column, missing_pct), worst first; `above=None` keeps all columns."""
    shares = column_missingness(df, exclude=(REASON, KEEP))
    if above is not None:
        shares = shares.where(F.col("missing_share") > above)
    return (
        shares.orderBy(F.desc("missing_share"), "column")
        .limit(top)
        .select("column", F.round(100 * F.col("missing_share"), 1).alias("missing_pct"))
    )


def removed_preview(df: DataFrame, order_cols: Sequence[str], rows: int = 50) -> DataFrame:
    return df.where(~F.col(KEEP).cast("boolean")).orderBy(*order_cols).limit(rows)


def preview(df: DataFrame, order_cols: Sequence[str], rows: int = 20) -> DataFrame:
    return df.orderBy(*order_cols).limit(rows)


def duration_checks(
    duration: Column, low: float = 5.0, high: float = 60.0
) -> list[Column]:
    return [
        F.when(duration.isNull(), F.lit("missing_duration")),
        F.when(duration <= 0, F.lit("nonpositive_duration")),
        F.when(
            (duration < low) | (duration > high), F.lit(f"duration_out_of_range({low}-{high})")
        ),
    ]


def rate_check(count: Column, hz: Column, max_hz: float = 10.0) -> Column:
    return (
        F.when(count.isNull(), F.lit("missing_tap_cnt_for_rate_qc"))
        .when(hz.isNull(), F.lit("missing_tap_hz"))
        .when(hz > max_hz, F.lit(f"tap_hz_too_high(>{max_hz})"))
    )


def session_qc(
    df: DataFrame,
    require_tap_rate: bool = False,
    min_dur: float = 5.0,
    max_dur: float = 60.0,
    max_tap_hz: float = 10.0,
    pid: str = "pid",
    session_id: str = "session_id",
    duration: str = "duration_sec",
    count: str = "tap_cnt",
    hz: str = "tap_hz",
) -> DataFrame:
    """Tapping-session checks: qc_reason is 'OK' or joined reasons, qc_keep is 0/1."""
    df = _fresh(df)
    checks = [
        F.when(blank(F.col(pid)), F.lit("missing_pid")),
        F.when(blank(F.col(session_id)), F.lit("missing_session_id")),
        *duration_checks(F.col(duration), min_dur, max_dur),
    ]
    if require_tap_rate:
        checks.append(rate_check(F.col(count), F.col(hz), max_tap_hz))
    return _reasons(df, checks, clean="OK", keep_type="int")


def short_session_qc(
    df: DataFrame, duration: str, minimum: float = 19.0, reason: str = "short_duration"
) -> DataFrame:
    df = _fresh(df)
    return _reasons(df, [F.when(F.col(duration) < minimum, F.lit(reason))], keep_type="int")


def role_qc(
    df: DataFrame,
    id_col: str | None = None,
    outcome_col: str | None = None,
    target_col: str | None = None,
    time: Column | None = None,
) -> DataFrame:
    """Checks of mapped roles; `time` is the parsed time when a time column is mapped."""
    df = _fresh(df)
    checks = []
    if id_col in df.columns:
        checks.append(F.when(blank(F.col(id_col)), F.lit("missing_id")))
    if outcome_col in df.columns:
        checks.append(F.when(F.col(outcome_col).isNull(), F.lit("missing_outcome")))
    if target_col in df.columns:
        checks.append(F.when(F.col(target_col).isNull(), F.lit("missing_target")))
    if time is not None:
        checks.append(F.when(time.isNull(), F.lit("unparseable_time")))
    return _reasons(df, checks, clean="OK", keep_type="int")


@dataclass(frozen=True)
class QcSplit:
    kept: DataFrame
    removed: DataFrame
    breakdown: DataFrame
    full: DataFrame


def split_qc(df: DataFrame) -> QcSplit:
    keep = F.col(KEEP).cast("boolean")
    return QcSplit(df.where(keep), df.where(~keep), reason_counts(df), df)
