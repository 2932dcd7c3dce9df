"""Quality control queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from studyspark.catalog.base import VISITS, query, table, visits
from studyspark.operators import qc

KEYS = ["user_id", "event_type", "day"]

FLAGS = (
    VISITS
    + """, b AS (
  SELECT quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM visits),
flagged AS (
  SELECT v.*,
    CASE WHEN value IS NULL THEN 'null_required:value' END AS r1,
    CASE WHEN row_number() OVER (PARTITION BY user_id, event_type, day ORDER BY event_id) > 1
         THEN 'duplicate_key' END AS r2,
    CASE WHEN value < q1 - 3 * (q3 - q1) OR value > q3 + 3 * (q3 - q1)
         THEN 'outlier:value' END AS r3
  FROM visits v, b),
qc AS (SELECT *, concat_ws(',', r1, r2, r3) AS qc_reason,
              concat_ws(',', r1, r2, r3) = '' AS qc_keep FROM flagged)"""
)


def flagged_visits(spark, folder, method="iqr"):
    return qc.run_qc(
        visits(spark, folder),
        required=["user_id", "value"],
        duplicate_keys=KEYS,
        order_cols=["event_id"],
        outlier_method=method,
        numeric_cols=["value"],
    )


@query(FLAGS + " SELECT event_id, value, qc_reason, qc_keep FROM qc")
def qc_flags_iqr(spark, folder):
    return flagged_visits(spark, folder).select("event_id", "value", "qc_reason", "qc_keep")


@query(
    VISITS
    + """, b AS (SELECT avg(value) AS m, stddev_samp(value) AS s FROM visits),
f AS (SELECT event_id, concat_ws(',',
    CASE WHEN value IS NULL THEN 'null_required:value' END,
    CASE WHEN row_number() OVER (PARTITION BY user_id, event_type, day ORDER BY event_id) > 1
         THEN 'duplicate_key' END,
    CASE WHEN abs((value - m) / s) > 3 THEN 'outlier:value' END) AS qc_reason
  FROM visits, b)
SELECT event_id, qc_reason, qc_reason = '' AS qc_keep FROM f"""
)
def qc_flags_zscore(spark, folder):
    return flagged_visits(spark, folder, "zscore").select("event_id", "qc_reason", "qc_keep")


@query(
    FLAGS
    + """ SELECT count(*) AS total, CAST(sum(CAST(qc_keep AS INT)) AS BIGINT) AS kept,
  CAST(count(*) - sum(CAST(qc_keep AS INT)) AS BIGINT) AS removed,
  round(100.0 * sum(CAST(qc_keep AS INT)) / count(*), 1) AS kept_pct FROM qc"""
)
def qc_summary(spark, folder):
    return qc.qc_totals(flagged_visits(spark, folder))


@query(
    FLAGS
    + """ SELECT reason, count(*) AS n_removed
FROM (SELECT unnest(string_split(qc_reason, ',')) AS reason FROM qc WHERE NOT qc_keep)
GROUP BY reason"""
)
def qc_reason_counts(spark, folder):
    return qc.reason_counts(flagged_visits(spark, folder))


@query(
    """WITH v AS (
  SELECT CASE WHEN event_type = 'signup' THEN NULL ELSE value END AS value,
         CASE WHEN event_type IN ('view', 'click') THEN NULL ELSE props END AS props
  FROM events)
SELECT "column", missing_pct FROM (
  SELECT 'value' AS "column", round(100.0 * avg(CAST(value IS NULL AS INT)), 1) AS missing_pct,
         avg(CAST(value IS NULL AS INT)) AS share FROM v
  UNION ALL
  SELECT 'props', round(100.0 * avg(CAST(props IS NULL AS INT)), 1),
         avg(CAST(props IS NULL AS INT)) FROM v)
WHERE share > 0.1"""
)
def qc_missing_columns(spark, folder):
    v = visits(spark, folder).withColumn(
        "props", F.when(~F.col("event_type").isin("view", "click"), F.col("props"))
    )
    return qc.missing_columns(v, above=0.1)


@query(FLAGS + " SELECT event_id, user_id, event_type, value FROM qc WHERE qc_keep")
def qc_kept(spark, folder):
    kept = qc.kept_rows(flagged_visits(spark, folder))
    return kept.select("event_id", "user_id", "event_type", "value")


@query(
    FLAGS
    + " SELECT event_id, user_id, qc_reason FROM qc WHERE NOT qc_keep ORDER BY event_id LIMIT 50"
)
def qc_removed_preview(spark, folder):
    flagged = flagged_visits(spark, folder)
    return qc.removed_preview(flagged, ["event_id"]).select("event_id", "user_id", "qc_reason")


@query(
    """SELECT event_id, CASE WHEN props LIKE '%1}' THEN 1 ELSE 0 END AS odd_prop,
  CASE WHEN (CAST(value IS NULL AS INT) + CAST(p IS NULL AS INT)) / 4.0 > 0.4
       THEN 'high_row_missingness' ELSE '' END AS qc_reason
FROM (SELECT event_id, user_id, props,
        CASE WHEN event_type = 'signup' THEN NULL ELSE value END AS value,
        CASE WHEN props LIKE '%1}' THEN NULL ELSE props END AS p FROM events)"""
)
def qc_row_missingness(spark, folder):
    odd = F.col("props").like("%1}")
    v = visits(spark, folder).select(
        "event_id", "user_id", "value", F.when(~odd, F.col("props")).alias("p")
    )
    out = qc.run_qc(v, row_missingness=0.4)
    return out.select("event_id", F.col("p").isNull().cast("int").alias("odd_prop"), "qc_reason")


@query(
    """SELECT event_id, 'missing_required_col:visit_date'
  || CASE WHEN event_type = 'signup' THEN ',null_required:value' ELSE '' END AS qc_reason,
  false AS qc_keep FROM events"""
)
def qc_missing_required(spark, folder):
    out = qc.run_qc(visits(spark, folder), required=["visit_date", "value"])
    return out.select("event_id", "qc_reason", "qc_keep")


# Visits as sessions: the value is the duration, clicks lost theirs, errors have a blank id.
SESSIONS = """WITH s AS (
  SELECT event_id,
    CASE WHEN event_type = 'error' THEN '  ' ELSE CAST(user_id AS VARCHAR) END AS pid,
    CASE WHEN event_type = 'view' AND value > 100 THEN NULL
         ELSE CAST(event_id AS VARCHAR) END AS session_id,
    CASE WHEN event_type = 'click' THEN NULL
         WHEN event_type = 'purchase' THEN value - 10 ELSE value END AS duration_sec,
    CASE WHEN event_type = 'signup' THEN NULL ELSE user_id END AS tap_cnt
  FROM events)"""


def sessions(spark, folder):
    kind = F.col("event_type")
    s = table(spark, folder, "events").select(
        "event_id",
        F.when(kind == "error", F.lit("  ")).otherwise(F.col("user_id").cast("string")).alias("pid"),
        F.when(~((kind == "view") & (F.col("value") > 100)), F.col("event_id").cast("string")).alias(
            "session_id"
        ),
        F.when(kind == "click", F.lit(None))
        .when(kind == "purchase", F.col("value") - 10)
        .otherwise(F.col("value"))
        .alias("duration_sec"),
        F.when(kind != "signup", F.col("user_id")).alias("tap_cnt"),
    )
    hz = F.when(F.col("duration_sec") > 0, F.col("tap_cnt") / F.col("duration_sec"))
    return s.withColumn("tap_hz", hz)


RANGE = """CASE WHEN duration_sec IS NULL THEN 'missing_duration' END,
    CASE WHEN duration_sec <= 0 THEN 'nonpositive_duration' END,
    CASE WHEN duration_sec < 5 OR duration_sec > 60 THEN 'duration_out_of_range(5.0-60.0)' END"""
BLANK = """CASE WHEN coalesce(trim(pid), '') = '' THEN 'missing_pid' END,
    CASE WHEN coalesce(trim(session_id), '') = '' THEN 'missing_session_id' END"""
STRICT = """CASE WHEN tap_cnt IS NULL THEN 'missing_tap_cnt_for_rate_qc'
         WHEN duration_sec IS NULL OR duration_sec <= 0 THEN 'missing_tap_hz'
         WHEN tap_cnt / duration_sec > 10 THEN 'tap_hz_too_high(>10.0)' END"""


@query(
    SESSIONS
    + f""", r AS (SELECT event_id, concat_ws(',', {BLANK}, {RANGE}) AS t FROM s)
SELECT event_id, CASE WHEN t = '' THEN 'OK' ELSE t END AS qc_reason,
       CAST(t = '' AS INT) AS qc_keep FROM r"""
)
def qc_range_checks(spark, folder):
    return qc.session_qc(sessions(spark, folder)).select("event_id", "qc_reason", "qc_keep")


@query(
    SESSIONS
    + f""", r AS (SELECT event_id, concat_ws(',', {BLANK}, {RANGE}, {STRICT}) AS t FROM s)
SELECT event_id, CASE WHEN t = '' THEN 'OK' ELSE t END AS qc_reason,
       CAST(t = '' AS INT) AS qc_keep FROM r"""
)
def qc_strict_rate(spark, folder):
    out = qc.session_qc(sessions(spark, folder), require_tap_rate=True)
    return out.select("event_id", "qc_reason", "qc_keep")


@query(
    SESSIONS
    + f""", r AS (SELECT unnest(string_split(concat_ws(',', {BLANK}, {RANGE}), ',')) AS reason
                  FROM s)
SELECT reason, count(*) AS n_removed FROM r WHERE reason <> '' GROUP BY reason"""
)
def qc_removal_breakdown(spark, folder):
    return qc.split_qc(qc.session_qc(sessions(spark, folder))).breakdown


@query(
    """SELECT event_id, value, CASE WHEN value < 19.0 THEN 'short_duration' ELSE '' END AS qc_reason,
  CASE WHEN value < 19.0 THEN 0 ELSE 1 END AS qc_keep FROM events"""
)
def qc_short_session(spark, folder):
    out = qc.short_session_qc(table(spark, folder, "events"), "value")
    return out.select("event_id", "value", "qc_reason", "qc_keep")


@query(
    """WITH v AS (SELECT event_id,
    CASE WHEN event_type = 'error' THEN ' ' ELSE CAST(user_id AS VARCHAR) END AS id,
    CASE WHEN event_type = 'view' THEN NULL ELSE event_type END AS outcome,
    CASE WHEN event_type = 'signup' THEN NULL ELSE value END AS target,
    CASE WHEN event_type = 'click' THEN NULL ELSE ts END AS t FROM events),
r AS (SELECT event_id, concat_ws(',',
    CASE WHEN trim(id) = '' THEN 'missing_id' END,
    CASE WHEN outcome IS NULL THEN 'missing_outcome' END,
    CASE WHEN target IS NULL THEN 'missing_target' END,
    CASE WHEN t IS NULL THEN 'unparseable_time' END) AS x FROM v)
SELECT event_id, CASE WHEN x = '' THEN 'OK' ELSE x END AS qc_reason,
       CAST(x = '' AS INT) AS qc_keep FROM r"""
)
def qc_roles(spark, folder):
    kind = F.col("event_type")
    v = visits(spark, folder).select(
        "event_id",
        F.when(kind == "error", F.lit(" ")).otherwise(F.col("user_id").cast("string")).alias("id"),
        F.when(kind != "view", kind).alias("outcome"),
        F.col("value").alias("target"),
        F.when(kind == "click", F.lit("not a date"))
        .otherwise(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))
        .alias("t"),
    )
    from studyspark.operators.standardise import parse_time

    out = qc.role_qc(v, "id", "outcome", "target", parse_time(v, "t", 0.7, 1e12, 1e9))
    return out.select("event_id", "qc_reason", "qc_keep")
