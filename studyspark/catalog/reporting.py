"""Report facts."""

from __future__ import annotations

from pyspark.sql import functions as F

from studyspark.catalog.base import query, table
from studyspark.catalog.comparing import SLOPE_FIT, TWO, rank_sql
from studyspark.catalog.modelling import NEWTON, TWO_FEATURES, labelled
from studyspark.catalog.quality import FLAGS, flagged_visits
from studyspark.operators import models
from studyspark.plans import report, study


@query(
    FLAGS
    + """, t AS (SELECT count(*) AS total, sum(CAST(qc_keep AS INT)) AS kept FROM qc),
u AS (SELECT reason, count(*) AS n FROM (SELECT unnest(string_split(qc_reason, ',')) AS reason
  FROM qc WHERE NOT qc_keep) GROUP BY 1)
SELECT 'qc' AS section, 1 AS ord, 'total' AS key, CAST(total AS VARCHAR) AS value FROM t
UNION ALL SELECT 'qc', 2, 'kept', CAST(kept AS VARCHAR) FROM t
UNION ALL SELECT 'qc', 3, 'removed', CAST(total - kept AS VARCHAR) FROM t
UNION ALL SELECT 'qc', 4, 'kept_pct', CAST(round(100.0 * kept / total, 1) AS VARCHAR) FROM t
UNION ALL SELECT 'qc_reasons', CAST(row_number() OVER (ORDER BY n DESC, reason) AS INT), reason,
  CAST(n AS VARCHAR) FROM u
UNION ALL SELECT 'qc_missing', 1, 'value', CAST(round(100.0 * avg(CAST(value IS NULL AS INT)), 1) AS VARCHAR)
  FROM qc HAVING avg(CAST(value IS NULL AS INT)) > 0.2"""
)
def report_qc(spark, folder):
    return report.qc_facts(flagged_visits(spark, folder))


@query(
    """WITH o AS (SELECT * FROM orders),
s AS (SELECT o_orderpriority AS k, avg(CAST(l = 'yes' AS INT)) AS v FROM
  (SELECT o_orderpriority, CASE WHEN o_totalprice > 250000 THEN 'yes' ELSE 'no' END AS l FROM o)
  GROUP BY 1),
c AS (SELECT CASE WHEN o_totalprice > 250000 THEN 'yes' ELSE 'no' END AS k, count(*) AS n FROM o GROUP BY 1),
m AS (SELECT strftime(o_orderdate, '%Y-%m') AS k, count(*) AS n FROM o GROUP BY 1 ORDER BY 1 LIMIT 12)
SELECT 'missing' AS section, CAST(row_number() OVER (ORDER BY name) AS INT) AS ord, name AS key,
  '0.0' AS value FROM (SELECT unnest(['large', 'o_custkey', 'o_orderdate', 'o_orderkey', 'o_orderpriority',
  'o_orderstatus', 'o_totalprice']) AS name)
UNION ALL SELECT 'rows', 1, 'total', CAST(count(*) AS VARCHAR) FROM o
UNION ALL SELECT 'rows', 2, 'kept', CAST(count(*) AS VARCHAR) FROM o
UNION ALL SELECT 'rows', 3, 'removed', '0'
UNION ALL SELECT 'rows', 4, 'kept_pct', '100.0'
UNION ALL SELECT 'outcome', CAST(row_number() OVER (ORDER BY n DESC, k) AS INT), k, CAST(n AS VARCHAR) FROM c
UNION ALL SELECT 'positive_share', CAST(row_number() OVER (ORDER BY k) AS INT), k, CAST(round(v, 4) AS VARCHAR) FROM s
UNION ALL SELECT 'months', CAST(row_number() OVER (ORDER BY k) AS INT), k, CAST(n AS VARCHAR) FROM m"""
)
def report_auto(spark, folder):
    """The generic overview."""
    from studyspark.operators import qc

    o = table(spark, folder, "orders").withColumn(
        "large", F.when(F.col("o_totalprice") > 250000, F.lit("yes")).otherwise(F.lit("no"))
    )
    flagged = qc.role_qc(o, "o_orderkey", "large")
    return report.auto_facts(flagged, "o_orderpriority", "large", "o_orderdate")


@query(
    NEWTON
    + """, c AS (SELECT count(*) AS n, count(*) FILTER ((p > 0.5) = (quality = 1)) AS good FROM y),
k AS (SELECT w, count(*) FILTER (quality = w) AS s, count(*) FILTER (CAST(p > 0.5 AS INT) = w) AS q,
  count(*) FILTER (quality = w AND CAST(p > 0.5 AS INT) = w) AS tp
  FROM y, (VALUES (0), (1)) AS l(w) GROUP BY w),
a AS (SELECT quality, rank() OVER (ORDER BY round(p, 10)) + (count(*) OVER (PARTITION BY round(p, 10)) - 1) / 2.0 AS rk FROM y)
SELECT 'model' AS section, 1 AS ord, 'task' AS key, 'classification' AS value
UNION ALL SELECT 'model', 2, 'split_type', 'random'
UNION ALL SELECT 'model', 3, 'n_train', CAST(count(*) AS VARCHAR) FROM s WHERE train
UNION ALL SELECT 'model', 4, 'n_test', CAST(count(*) AS VARCHAR) FROM s WHERE NOT train
UNION ALL SELECT 'model', 5, 'best_model', 'Logistic Regression'
UNION ALL SELECT 'model', 6, 'rare_classes', CASE WHEN count(*) < 200 AND
  least(count(*) FILTER (quality = 0), count(*) FILTER (quality = 1)) < 5 THEN 'True' ELSE 'False' END FROM s
UNION ALL SELECT 'metrics', 1, 'Logistic Regression: accuracy', CAST(round(good / n, 4) AS VARCHAR) FROM c
UNION ALL SELECT 'metrics', 2, 'Logistic Regression: auc', CAST(round((sum(rk) FILTER (quality = 1)
  - count(*) FILTER (quality = 1) * (count(*) FILTER (quality = 1) + 1) / 2.0)
  / (count(*) FILTER (quality = 1) * count(*) FILTER (quality = 0)), 4) AS VARCHAR) FROM a
UNION ALL SELECT 'metrics', 3, 'Logistic Regression: f1_weighted',
  CAST(round(sum(s * coalesce(2.0 * tp / nullif(s + q, 0), 0)) / sum(s), 4) AS VARCHAR) FROM k"""
)
def report_model(spark, folder):
    run = models.run_classification(
        labelled(spark, folder), "quality", "doc_id", TWO_FEATURES, models=[models.LOGISTIC], importance=False
    )
    return report.model_facts(spark, run)


STUDY = (
    """WITH os AS (SELECT *, CASE WHEN o_totalprice > 0 AND o_totalprice <= 200000 THEN 'small'
    WHEN o_totalprice > 200000 AND o_totalprice <= 1000000 THEN 'large' END AS size FROM orders),
bs AS (SELECT quantile_cont(o_totalprice, 0.25) AS q1, quantile_cont(o_totalprice, 0.75) AS q3 FROM os),
fs AS (SELECT os.*, concat_ws(',',
    CASE WHEN row_number() OVER (PARTITION BY o_custkey, o_orderdate ORDER BY o_orderkey) > 1
         THEN 'duplicate_key' END,
    CASE WHEN o_totalprice < q1 - 3 * (q3 - q1) OR o_totalprice > q3 + 3 * (q3 - q1)
         THEN 'outlier:o_totalprice' END) AS reason FROM os, bs),
ks AS (SELECT * FROM fs WHERE reason = ''),
ts AS (SELECT count(*) AS total, CAST(sum(CAST(reason = '' AS INT)) AS BIGINT) AS kept FROM fs),
us AS (SELECT unnest(string_split(reason, ',')) AS reason FROM fs WHERE reason <> ''),
vs AS (SELECT reason, count(*) AS n FROM us GROUP BY 1)"""
    + rank_sql("SELECT 'o_totalprice' AS feature, size AS g, o_totalprice AS v FROM ks", ",")
    + TWO
    + SLOPE_FIT.replace("WITH om", ", om").replace("FROM orders", "FROM ks")
    + """, qs AS (SELECT quantile_cont(slope, 0.5) AS md, quantile_cont(slope, 0.75) AS q FROM sl),
ps AS (SELECT count(*) AS n, round(avg(slope), 6) AS mean, round(any_value(md), 6) AS median,
  round(stddev_samp(slope), 6) AS sd, round(any_value(q), 6) AS cut,
  count(*) FILTER (slope >= q) AS fast,
  round(100.0 * count(*) FILTER (slope >= q) / count(*), 1) AS pct FROM sl, qs)
SELECT 'qc' AS section, 1 AS ord, 'total' AS key, CAST(total AS VARCHAR) AS value FROM ts
UNION ALL SELECT 'qc', 2, 'kept', CAST(kept AS VARCHAR) FROM ts
UNION ALL SELECT 'qc', 3, 'removed', CAST(total - kept AS VARCHAR) FROM ts
UNION ALL SELECT 'qc', 4, 'kept_pct', CAST(round(100.0 * kept / total, 1) AS VARCHAR) FROM ts
UNION ALL SELECT 'qc_reasons', CAST(row_number() OVER (ORDER BY n DESC, reason) AS INT), reason,
  CAST(n AS VARCHAR) FROM vs
UNION ALL SELECT 'describe', 1, 'o_totalprice', 'mean=' || round(avg(o_totalprice), 4) || ', SD='
  || round(stddev_samp(o_totalprice), 4) || ', median=' || round(quantile_cont(o_totalprice, 0.5), 4)
  || ', missing=0.0%' FROM ks
UNION ALL SELECT 'compare', 1, feature, 'effect=' || effect_size || '; '
  || CASE WHEN abs(effect_size) >= 0.8 THEN 'LARGE' WHEN abs(effect_size) >= 0.5 THEN 'medium'
     WHEN abs(effect_size) >= 0.2 THEN 'small' ELSE 'negligible' END || '; p=' || p_value || '; '
  || CASE WHEN p_value < 0.05 THEN 'significant' ELSE 'not significant' END
  || '; expected=UNKNOWN' FROM c
UNION ALL SELECT 'progression', 1, 'n_subjects', CAST(n AS VARCHAR) FROM ps
UNION ALL SELECT 'progression', 2, 'mean_slope', CAST(mean AS VARCHAR) FROM ps
UNION ALL SELECT 'progression', 3, 'median_slope', CAST(median AS VARCHAR) FROM ps
UNION ALL SELECT 'progression', 4, 'sd_slope', CAST(sd AS VARCHAR) FROM ps
UNION ALL SELECT 'progression', 5, 'fast_progressor_threshold', CAST(cut AS VARCHAR) FROM ps
UNION ALL SELECT 'progression', 6, 'n_fast_progressors', CAST(fast AS VARCHAR) FROM ps
UNION ALL SELECT 'progression', 7, 'pct_fast', CAST(pct AS VARCHAR) FROM ps"""
    + "".join(
        f" UNION ALL SELECT 'limitations', {i}, '{i}', '{text}'"
        for i, text in enumerate(report.LIMITATIONS, 1)
    )
)


@query(STUDY)
def study_report(spark, folder):
    """The whole study on orders: rules, QC, describe, compare, progression, report."""
    config = {
        "entity_id": "o_custkey",
        "time_col": "o_orderdate",
        "group_col": "size",
        "outcome_col": "o_totalprice",
        "rules": [
            {
                "type": "numeric_bin",
                "source_col": "o_totalprice",
                "output_col": "size",
                "bins": [0, 200000, 1000000],
                "labels": ["small", "large"],
            }
        ],
        "duplicate_keys": ["o_custkey", "o_orderdate"],
    }
    return study.run_study(table(spark, folder, "orders"), config, ["o_orderkey"])["report"]
