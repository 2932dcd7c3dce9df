"""From raw tapping sessions to the fixed analysis table."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from studyspark.functions import signal
from studyspark.functions.coerce import numeric_of
from studyspark.operators.qc import QcSplit, session_qc, split_qc
from studyspark.operators.standardise import normal_name, normalise_columns
from studyspark.roles import SESSION_CANDIDATES, guess_columns

# Output columns of the cleaning flow.
ANALYSIS_COLUMNS = (
    "pid",
    "session_id",
    "med_timepoint_raw",
    "dx_proxy",
    "pd_state",
    "pd_code",
    "duration_sec",
    "tap_cnt",
    "tap_hz",
    "tap_per10s",
    "tap_samples_is_filehandle",
)


def tap_metrics(
    df: DataFrame,
    count: str | None = None,
    duration: str | None = None,
    stamps: str | None = None,
) -> DataFrame:
    """Add tap_rate, tap_variability and tap_fatigue_slope where their inputs exist."""
    out = df
    if count in df.columns and duration in df.columns:
        out = out.withColumn("tap_rate", signal.rate(numeric_of(df, count), numeric_of(df, duration)))
    if stamps in df.columns:
        # the list is parsed once per row into its own column
        out = out.withColumn("_stamps", signal.time_list(F.col(stamps).cast("string")))
        out = out.withColumns(
            {
                "tap_variability": signal.gap_sd(F.col("_stamps")),
                "tap_fatigue_slope": signal.half_rates(F.col("_stamps")),
            }
        ).drop("_stamps")
    return out


def tap_features(df: DataFrame, taps: str, duration: str) -> DataFrame:
    """Add tap_cnt, tap_samples_is_filehandle, tap_hz and tap_per10s."""
    count = signal.tap_count(F.col(taps), df.schema[taps].dataType)
    return (
        df.withColumn("tap_cnt", count)
        .withColumn("tap_samples_is_filehandle", F.col("tap_cnt").isNull().cast("bigint"))
        .withColumn("tap_hz", signal.tap_frequency(F.col("tap_cnt"), F.col(duration)))
        .withColumn("tap_per10s", F.col("tap_hz") * 10.0)
    )


def medication_columns(df: DataFrame, text: str, null_policy: str = "other") -> DataFrame:
    """Add med_state, med_code, dx_proxy, pd_state and pd_code."""
    return (
        df.withColumn("med_state", signal.medication_state(F.col(text), null_policy))
        .withColumn("med_code", signal.code_of(F.col("med_state"), signal.MEDICATION_CODES))
        .withColumn("dx_proxy", signal.proxy_diagnosis(F.col("med_state")))
        .withColumn("pd_state", F.when(F.col("dx_proxy") == 1, F.col("med_state")))
        .withColumn("pd_code", signal.code_of(F.col("pd_state"), signal.STATE_CODES))
    )


def session_columns(
    raw: DataFrame, mapping: Mapping[str, str | None] | None = None, null_policy: str = "other"
) -> DataFrame:
    """The analysis columns; roles that are not mapped give empty or NULL columns."""
    df = normalise_columns(raw, "loose")
    given = guess_columns(df.columns, SESSION_CANDIDATES) if mapping is None else mapping
    role = {k: normal_name(v, "loose") if v else None for k, v in given.items()}

    def text(name: str):
        return F.col(role[name]).cast("string") if role.get(name) else F.lit("")

    start, end = role.get("start_ms"), role.get("end_ms")
    if start and end:
        duration = (numeric_of(df, end) - numeric_of(df, start)) / 1000.0
    else:
        duration = F.lit(None).cast("double")
    taps = role.get("tap_data")
    out = df.select(
        text("pid").alias("pid"),
        text("session_id").alias("session_id"),
        text("med_timepoint").alias("med_timepoint_raw"),
        duration.alias("duration_sec"),
        *([F.col(taps).alias("_taps")] if taps else []),
    )
    if role.get("med_timepoint"):
        out = medication_columns(out, "med_timepoint_raw", null_policy)
    else:
        none = F.lit(None)
        out = out.withColumns(
            {
                "dx_proxy": none.cast("bigint"),
                "pd_state": none.cast("string"),
                "pd_code": none.cast("bigint"),
            }
        )
    if taps:
        out = tap_features(out, "_taps", "duration_sec")
    else:
        none = F.lit(None)
        out = out.withColumns(
            {
                "tap_cnt": none.cast("bigint"),
                "tap_hz": none.cast("double"),
                "tap_per10s": none.cast("double"),
                "tap_samples_is_filehandle": none.cast("bigint"),
            }
        )
    return out.select(*ANALYSIS_COLUMNS)


def clean_sessions(
    raw: DataFrame,
    mapping: Mapping[str, str | None] | None = None,
    null_policy: str = "other",
    **qc,
) -> QcSplit:
    """Map roles, derive features, flag sessions: one lazy plan, nothing dropped."""
    return split_qc(session_qc(session_columns(raw, mapping, null_policy), **qc))
