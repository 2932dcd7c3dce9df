"""Group comparison, paired comparison and progression."""

from __future__ import annotations

from pyspark.sql import functions as F

from studyspark.catalog.base import (
    ORDER_MONTHS,
    VISITS,
    query,
    sql_erfc,
    sql_normal_two_sided,
    table,
    visits,
)
from studyspark.operators import compare, paired, progression
from studyspark.operators.standardise import months_since_baseline

FEATURES = ["l_quantity", "l_extendedprice", "l_discount"]


def _long_sql(features: list[str], group: str, src: str = "lineitem") -> str:
    parts = [f"SELECT '{c}' AS feature, {group} AS g, {c} AS v FROM {src}" for c in features]
    return " UNION ALL ".join(parts)


def rank_sql(long_sql: str, start: str = "WITH") -> str:
    return f"""{start} x AS ({long_sql}),
r AS (SELECT feature, g, v, rank() OVER (PARTITION BY feature ORDER BY v)
        + (count(*) OVER (PARTITION BY feature, v) - 1) / 2.0 AS rk,
        CAST(count(*) OVER (PARTITION BY feature, v) AS DOUBLE) AS t
      FROM x WHERE v IS NOT NULL AND g IS NOT NULL),
m AS (SELECT feature, g, CAST(count(*) AS DOUBLE) AS n, avg(v) AS mean, var_samp(v) AS var,
        sum(rk) AS rs, sum(t * t - 1) AS ties FROM r GROUP BY 1, 2)"""


TWO = """, p AS (SELECT a.feature, a.g AS ga, b.g AS gb, a.n AS na, b.n AS nb, a.n + b.n AS n,
  a.rs - a.n * (a.n + 1) / 2 AS u, a.ties + b.ties AS ties,
  CASE WHEN (a.n - 1) * a.var + (b.n - 1) * b.var = 0 THEN 0 ELSE
  (a.mean - b.mean) / sqrt(((a.n - 1) * a.var + (b.n - 1) * b.var) / (a.n + b.n - 2)) END AS d
  FROM m a JOIN m b ON a.feature = b.feature AND a.g < b.g),
z AS (SELECT *, (greatest(u, na * nb - u) - na * nb / 2 - 0.5)
        / sqrt(na * nb / 12 * (n + 1 - ties / (n * (n - 1)))) AS z FROM p),
c AS (SELECT *, round({tail}, 4) AS p_value, round(d, 4) AS effect_size FROM z)""".format(
    tail=sql_normal_two_sided("z")
)
KRUSKAL = """, k AS (SELECT feature, count(*) AS n_groups, sum(n) AS n, sum(ties) AS ties,
  12 / (sum(n) * (sum(n) + 1)) * sum(rs * rs / n) - 3 * (sum(n) + 1) AS h0,
  sum((n - 1) * var) AS within, sum(n * mean * mean) AS s2, sum(n * mean) AS s1 FROM m GROUP BY 1),
h AS (SELECT *, h0 / (1 - ties / (n * n * n - n)) AS h, s2 - s1 * s1 / n AS between_ss FROM k)"""


@query(
    rank_sql(_long_sql(FEATURES, "l_returnflag"))
    + """ SELECT feature, g AS "group", round(mean, 4) AS mean, round(sqrt(var), 4) AS sd,
  CAST(n AS BIGINT) AS n FROM m"""
)
def group_stats(spark, folder):
    return compare.comparison_stats(table(spark, folder, "lineitem"), FEATURES, "l_returnflag")


@query(
    rank_sql(_long_sql(FEATURES, "l_linestatus"))
    + TWO
    + """ SELECT feature, CAST(2 AS BIGINT) AS n_groups, CAST(n AS BIGINT) AS n_total,
  ga AS group_a, gb AS group_b, 'Mann-Whitney U' AS test, 'asymptotic' AS method,
  round(u, 4) AS statistic, p_value, effect_size, 'Cohen''s d' AS effect_size_type FROM c"""
)
def compare_two_groups(spark, folder):
    return compare.compare_groups(table(spark, folder, "lineitem"), FEATURES, "l_linestatus")


@query(
    rank_sql(_long_sql(FEATURES, "l_returnflag"))
    + KRUSKAL
    + """ SELECT feature, n_groups, CAST(n AS BIGINT) AS n_total, 'Kruskal-Wallis' AS test,
  'asymptotic' AS method, round(h, 4) AS statistic, round(exp(-h / 2), 4) AS p_value,
  round(between_ss / (between_ss + within), 4) AS effect_size, 'eta-squared' AS effect_size_type
FROM h"""
)
def compare_k_groups(spark, folder):
    got = compare.compare_groups(table(spark, folder, "lineitem"), FEATURES, "l_returnflag")
    return got.drop("group_a", "group_b")


# Order lines under gait names, so that the metric guide applies.
GAIT = """SELECT l_quantity AS velocity_cm, l_extendedprice AS stride_width_mean,
  l_discount AS double_time, l_tax AS anything, l_linestatus FROM lineitem"""
GAIT_FEATURES = ["velocity_cm", "stride_width_mean", "double_time", "anything"]


def gait(spark, folder):
    return table(spark, folder, "lineitem").select(
        F.col("l_quantity").alias("velocity_cm"),
        F.col("l_extendedprice").alias("stride_width_mean"),
        F.col("l_discount").alias("double_time"),
        F.col("l_tax").alias("anything"),
        "l_linestatus",
    )


@query(
    rank_sql(_long_sql(GAIT_FEATURES, "l_linestatus", f"({GAIT})"))
    + TWO
    + """ SELECT feature, effect_size, p_value,
  CASE WHEN abs(effect_size) >= 0.8 THEN 'LARGE' WHEN abs(effect_size) >= 0.5 THEN 'medium'
    WHEN abs(effect_size) >= 0.2 THEN 'small' ELSE 'negligible' END AS effect_label,
  p_value < 0.05 AS is_significant,
  CASE WHEN feature LIKE '%velocity%' THEN 'LOWER in PD'
    WHEN feature LIKE '%stride_width%' THEN 'VARIABLE'
    WHEN feature LIKE '%double%' THEN 'HIGHER in PD' ELSE 'UNKNOWN' END AS expected
FROM c ORDER BY effect_size DESC, feature LIMIT 25"""
)
def metric_guide_lookup(spark, folder):
    got = compare.compare_groups(gait(spark, folder), GAIT_FEATURES, "l_linestatus")
    top = compare.top_effects(compare.annotate_comparison(got), 25)
    return top.select(
        "feature", "effect_size", "p_value", "effect_label", "is_significant", "expected"
    )


@query(
    VISITS
    + rank_sql("SELECT 'value' AS feature, event_type AS g, value AS v FROM visits", ",")
    + KRUSKAL
    + """ SELECT feature, n_groups, CAST(n AS BIGINT) AS n_total, round(h, 4) AS statistic,
  round(between_ss / (between_ss + within), 4) AS effect_size,
  -- four conditions have values: the upper tail with three degrees of freedom
  round(ERFC + sqrt(2 * h / pi()) * exp(-h / 2), 4) AS p_value FROM h""".replace(
        "ERFC", sql_erfc("sqrt(h / 2)")
    )
)
def condition_comparison(spark, folder):
    """A few-valued condition column: compare the outcome across its values."""
    got = compare.condition_analysis(visits(spark, folder), "event_type", "value")["comparison"]
    return got.select("feature", "n_groups", "n_total", "statistic", "effect_size", "p_value")


PAIRS = """WITH RECURSIVE pr AS (SELECT a.user_id AS e, a.value AS va, b.value AS vb
  FROM events a JOIN events b ON a.user_id = b.user_id
  WHERE a.event_type = 'click' AND b.event_type = 'view')"""
PAIRS_MEAN = """WITH RECURSIVE s AS (SELECT user_id AS e, avg(CASE WHEN event_type = 'click' THEN value END) AS va,
  avg(CASE WHEN event_type = 'view' THEN value END) AS vb FROM events GROUP BY 1),
pr AS (SELECT e, va, vb FROM s WHERE va IS NOT NULL AND vb IS NOT NULL)"""
SIGNED = """, d AS (SELECT abs(va - vb) AS v, va > vb AS pos FROM pr WHERE va <> vb),
r AS (SELECT pos, rank() OVER (ORDER BY v) + (count(*) OVER (PARTITION BY v) - 1) / 2.0 AS rk,
        CAST(count(*) OVER (PARTITION BY v) AS DOUBLE) AS t FROM d),
w AS (SELECT CAST(count(*) AS DOUBLE) AS nz, sum(CASE WHEN pos THEN rk ELSE 0 END) AS wp,
        sum(CASE WHEN pos THEN 0 ELSE rk END) AS wn, sum(t * t - 1) AS ties FROM r),
g AS (SELECT count(*) AS n_pairs, count(DISTINCT e) AS n_entities, avg(va) AS ma, avg(vb) AS mb,
        avg(va - vb) AS md, var_samp(va) AS xa, var_samp(vb) AS xb, stddev_samp(va - vb) AS sd
      FROM pr),
o AS (SELECT *, (least(wp, wn) - nz * (nz + 1) / 4)
        / sqrt(nz * (nz + 1) * (2 * nz + 1) / 24 - ties / 48) AS z,
        nz = n_pairs AND n_pairs <= 50 AND ties = 0 AS exact FROM w, g),
ways(k, ws) AS (
  SELECT CAST(0 AS BIGINT), [CASE WHEN i = 1 THEN 1.0::DOUBLE ELSE 0 END for i in range(1, 1277)]
  UNION ALL
  SELECT k + 1, [ws[i] + CASE WHEN i > k + 1 THEN ws[i - k - 1] ELSE 0 END for i in range(1, 1277)]
  FROM ways WHERE k < (SELECT CASE WHEN exact THEN n_pairs ELSE 0 END FROM o)),
lw AS (SELECT ws FROM ways ORDER BY k DESC LIMIT 1)
SELECT 'value' AS feature, round(ma, 4) AS mean_a, round(mb, 4) AS mean_b,
  round(md, 4) AS mean_diff, n_pairs, n_entities, 'Wilcoxon' AS test,
  CASE WHEN exact THEN 'exact' ELSE 'asymptotic' END AS method,
  round(least(wp, wn), 4) AS statistic,
  round(CASE WHEN exact THEN least(1.0, 2 * list_sum(ws[1:CAST(least(wp, wn) AS BIGINT) + 1])
    / pow(2, n_pairs)) ELSE {tail} END, 4) AS p_value,
  round((ma - mb) / sqrt((xa + xb) / 2), 4) AS effect_size_d FROM o, lw""".format(
    tail=sql_normal_two_sided("z")
)


@query(PAIRS + SIGNED)
def within_subject(spark, folder):
    return paired.within_subject(
        table(spark, folder, "events"), ["value"], "user_id", "event_type", "click", "view"
    )


CENTS = "abs(CAST(round(va * 100) AS BIGINT) - CAST(round(vb * 100) AS BIGINT)) AS v"


@query(
    PAIRS.replace("a.user_id AS e", "a.user_id % 7 AS e").replace("a.user_id = b.user_id", "a.user_id % 7 = b.user_id % 7")
    + SIGNED.replace("abs(va - vb) AS v", CENTS)
)
def within_subject_grid(spark, folder):
    """Few entities with very many pairs each: decimal differences from convolved histograms."""
    e = table(spark, folder, "events").withColumn("cohort", F.col("user_id") % 7)
    return paired.within_subject(e, ["value"], "cohort", "event_type", "click", "view", decimals=2)


@query(PAIRS_MEAN + SIGNED)
def within_subject_means(spark, folder):
    return paired.within_subject(
        table(spark, folder, "events"),
        ["value"],
        "user_id",
        "event_type",
        "click",
        "view",
        pairing="mean",
    )


@query(
    PAIRS
    + """, g AS (SELECT count(*) AS n, avg(va - vb) AS md, stddev_samp(va - vb) AS sd FROM pr),
t AS (SELECT *, md / (sd / sqrt(n)) AS t, n - 1.5 AS a FROM g),
q AS (SELECT *, sqrt(a * ln(1 + t * t / (n - 1))) AS z0, 48 * a * a AS b FROM t),
u AS (SELECT *, z0 + (pow(z0, 3) + 3 * z0) / b - (4 * pow(z0, 7) + 33 * pow(z0, 5)
        + 240 * pow(z0, 3) + 855 * z0) / (10 * b * (b + 0.8 * pow(z0, 4) + 100)) AS u FROM q)
SELECT 'value' AS feature, n AS n_pairs, round(md, 4) AS mean_diff, round(sd, 4) AS sd_diff,
  round(t, 4) AS t, round({tail}, 4) AS p_value FROM u""".format(tail=sql_normal_two_sided("u"))
)
def paired_t(spark, folder):
    """All pairs of the many-to-many match, from per-user moments alone."""
    return paired.paired_t(
        table(spark, folder, "events"), ["value"], "user_id", "event_type", "click", "view"
    )


# p of a slope from the finite t series, its ratios of factorials as gamma functions.
SLOPE_FIT = (
    ORDER_MONTHS
    + """, f AS (SELECT o_custkey, regr_slope(o_totalprice, months) AS s,
  regr_intercept(o_totalprice, months) AS i, var_pop(months) AS vx, var_pop(o_totalprice) AS vy,
  CASE WHEN var_pop(o_totalprice) = 0 THEN 0 ELSE least(regr_r2(o_totalprice, months), 1) END AS r2,
  count(*) AS n FROM om GROUP BY 1 HAVING count(*) >= 3),
h AS (SELECT *, n - 2 AS df, atan(sqrt(r2) * sqrt((n - 2) / ((1 - sqrt(r2) + 1e-20)
  * (1 + sqrt(r2) + 1e-20))) / sqrt(n - 2)) AS th FROM f WHERE vx > 0),
e AS (SELECT *, CASE WHEN df % 2 = 1 THEN (th + CASE WHEN df > 1 THEN sin(th) * cos(th)
    * list_sum([pow(cos(th), 2 * k) * sqrt(pi()) / 2 * gamma(k + 1.0) / gamma(k + 1.5)
                for k in range(0, (df - 3) // 2 + 1)]) ELSE 0 END) * 2 / pi()
  ELSE sin(th) * list_sum([pow(cos(th), 2 * k) * gamma(k + 0.5) / sqrt(pi()) / gamma(k + 1.0)
                for k in range(0, (df - 2) // 2 + 1)]) END AS inside FROM h),
sl AS (SELECT o_custkey, round(s, 6) AS slope, round(i, 4) AS intercept, round(r2, 4) AS r2,
  round(least(greatest(1 - inside, 0), 1), 4) AS p_value, n AS n_visits FROM e)"""
)


def order_slopes(spark, folder):
    return progression.slopes_by_months(
        table(spark, folder, "orders"), "o_custkey", "o_orderdate", "o_totalprice"
    )


@query(SLOPE_FIT + " SELECT * FROM sl")
def slopes(spark, folder):
    got = order_slopes(spark, folder)
    return got.where("status = 'ok'").drop("status")


@query(
    VISITS
    + """ SELECT user_id, round(regr_slope(value, event_id), 6) AS slope,
  round(regr_r2(value, event_id), 4) AS r2, count(value) AS n_visits FROM visits
GROUP BY 1 HAVING count(value) >= 3"""
)
def slopes_raw_axis(spark, folder):
    """A plain numeric axis instead of months."""
    got = progression.slopes(visits(spark, folder), "user_id", "event_id", "value")
    return got.select("user_id", "slope", "r2", "n_visits")


@query(
    SLOPE_FIT
    + """, q AS (SELECT quantile_cont(slope, 0.5) AS md, quantile_cont(slope, 0.75) AS q FROM sl)
SELECT count(*) AS n_subjects, round(avg(slope), 6) AS mean_slope, round(any_value(md), 6) AS median_slope,
  round(stddev_samp(slope), 6) AS sd_slope, round(any_value(q), 6) AS fast_progressor_threshold,
  count(*) FILTER (slope >= q) AS n_fast_progressors,
  round(100.0 * count(*) FILTER (slope >= q) / count(*), 1) AS pct_fast FROM sl, q"""
)
def progression_summary(spark, folder):
    return progression.progression_summary(order_slopes(spark, folder))


@query(
    SLOPE_FIT
    + """ SELECT o_custkey, slope, slope >= (SELECT quantile_cont(slope, 0.75) FROM sl) AS is_fast FROM sl"""
)
def fast_progressors(spark, folder):
    got = progression.fast_progressors(order_slopes(spark, folder))
    return got.where("status = 'ok'").select("o_custkey", "slope", "is_fast")


def order_months(spark, folder):
    return months_since_baseline(
        table(spark, folder, "orders"), "o_custkey", "o_orderdate", "months"
    )


@query(
    """WITH m AS (SELECT l_suppkey, count(*) FILTER (l_linestatus = 'F') AS na, count(*) FILTER (l_linestatus = 'O') AS nb,
  avg(l_linenumber) FILTER (l_linestatus = 'F') AS ma, avg(l_linenumber) FILTER (l_linestatus = 'O') AS mb,
  var_samp(l_linenumber) FILTER (l_linestatus = 'F') AS va, var_samp(l_linenumber) FILTER (l_linestatus = 'O') AS vb
  FROM lineitem WHERE l_linenumber <= 1 + l_suppkey % 3 GROUP BY l_suppkey),
p AS (SELECT *, sqrt(((na - 1) * va + (nb - 1) * vb) / nullif(na + nb - 2, 0)) AS sd FROM m)
SELECT l_suppkey, CASE WHEN na >= 2 AND nb >= 2 AND sd > 0 THEN round((ma - mb) / sd, 6) END AS d FROM p"""
)
def effect_of_constants(spark, folder):
    """Cohen's d per supplier, NULL where both groups are constant."""
    line = table(spark, folder, "lineitem").where(F.col("l_linenumber") <= 1 + F.col("l_suppkey") % 3)
    x = {g: F.when(F.col("l_linestatus") == g, F.col("l_linenumber").cast("double")) for g in ("F", "O")}
    m = line.groupBy("l_suppkey").agg(
        *[f(x[g]).alias(f"{n}{g}") for g in x for n, f in (("n", F.count), ("m", F.avg), ("v", F.var_samp))]
    )
    d = compare.pooled_d(*[F.col(c) for c in ("mF", "mO", "vF", "vO", "nF", "nO")], zero_sd="null")
    return m.select("l_suppkey", F.round(d, 6).alias("d"))
