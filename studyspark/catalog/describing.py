"""Descriptive tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from studyspark.catalog.base import VISITS, query, table, visits
from studyspark.operators import describe, standardise

LINE_COLS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def _describe_sql(name: str, col: str, src: str) -> str:
    return f"""SELECT '{name}' AS "column", count({col}) AS n,
  CAST(0 AS BIGINT) AS n_uncoercible,
  round(100.0 * avg(CAST({col} IS NULL AS INT)), 1) AS missing_pct,
  round(avg({col}), 4) AS mean, round(stddev_samp({col}), 4) AS sd,
  round(quantile_cont({col}, 0.5), 4) AS median,
  round(quantile_cont({col}, 0.75) - quantile_cont({col}, 0.25), 4) AS iqr,
  round(min({col}), 4) AS min, round(max({col}), 4) AS max FROM {src}"""


@query(" UNION ALL ".join(_describe_sql(c, c, "lineitem") for c in LINE_COLS))
def describe_numeric(spark, folder):
    return describe.describe_numeric(table(spark, folder, "lineitem"), LINE_COLS)


@query(
    VISITS
    + ", t AS (SELECT event_id, CASE WHEN event_type = 'error' THEN NULL ELSE value END AS v, "
    + "event_type, value FROM visits) "
    + """SELECT 'cell' AS "column", count(v) AS n,
  CAST(count(*) FILTER (event_type = 'error') AS BIGINT) AS n_uncoercible,
  round(100.0 * avg(CAST(value IS NULL AND event_type <> 'error' AS INT)), 1) AS missing_pct,
  round(avg(v), 4) AS mean, round(stddev_samp(v), 4) AS sd,
  round(quantile_cont(v, 0.5), 4) AS median,
  round(quantile_cont(v, 0.75) - quantile_cont(v, 0.25), 4) AS iqr,
  round(min(v), 4) AS min, round(max(v), 4) AS max FROM t"""
)
def describe_text_numbers(spark, folder):
    """Numbers kept as text: unreadable cells count apart from missing ones."""
    v = visits(spark, folder).withColumn(
        "cell",
        F.when(F.col("event_type") == "error", F.lit("bad")).otherwise(F.col("value").cast("string")),
    )
    return describe.describe_numeric(v, ["cell"])


def _count_sql(col: str) -> str:
    return f"""SELECT '{col}' AS "column", CAST({col} AS VARCHAR) AS value, count(*) AS n,
  round(100.0 * count(*) / (SELECT count(*) FROM o), 1) AS pct FROM o GROUP BY {col}"""


@query(
    "WITH o AS (SELECT o_orderpriority, CASE WHEN o_orderstatus = 'P' THEN NULL "
    "ELSE o_orderstatus END AS o_orderstatus FROM orders) "
    + " UNION ALL ".join(_count_sql(c) for c in ("o_orderpriority", "o_orderstatus"))
)
def describe_categorical(spark, folder):
    o = table(spark, folder, "orders").withColumn(
        "o_orderstatus", F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus"))
    )
    return describe.describe_categorical(o, ["o_orderpriority", "o_orderstatus"])


@query(
    """WITH c AS (SELECT CAST(user_id AS VARCHAR) AS value, count(*) AS n FROM events GROUP BY 1),
r AS (SELECT *, row_number() OVER (ORDER BY n DESC, value) AS k FROM c)
SELECT value, n, false AS is_rest FROM r WHERE k <= 15
UNION ALL SELECT '(others)', CAST(sum(n) AS BIGINT), true FROM r WHERE k > 15
HAVING count(*) > 0"""
)
def top_values_others(spark, folder):
    return describe.top_values(table(spark, folder, "events"), "user_id", 15)


@query(
    VISITS
    + """ SELECT 'event_id' AS "column", 'bigint' AS dtype, 'numeric' AS kind,
  avg(CAST(event_id IS NULL AS INT)) AS missing_share FROM visits
UNION ALL SELECT 'user_id', 'bigint', 'numeric', avg(CAST(user_id IS NULL AS INT)) FROM visits
UNION ALL SELECT 'event_type', 'string', 'categorical', avg(CAST(event_type IS NULL AS INT)) FROM visits
UNION ALL SELECT 'value', 'double', 'numeric', round(avg(CAST(value IS NULL AS INT)), 6) FROM visits
UNION ALL SELECT 'day', 'date', 'categorical', avg(CAST(day IS NULL AS INT)) FROM visits"""
)
def profile_columns(spark, folder):
    v = visits(spark, folder).select("event_id", "user_id", "event_type", "value", "day")
    got = describe.profile_columns(v, 25)
    return got.withColumn("missing_share", F.round("missing_share", 6))


@query(
    """SELECT CAST(sum(n) AS BIGINT) AS n_rows, CAST(11 AS BIGINT) AS n_cols,
  CAST(sum(n - 1) AS BIGINT) AS duplicate_rows
FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey, l_partkey, l_suppkey, l_linenumber,
  l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate)"""
)
def profile_totals(spark, folder):
    line = table(spark, folder, "lineitem")
    return describe.profile_totals(line)


@query(
    """WITH o AS (SELECT o_orderpriority, CASE WHEN o_orderstatus = 'P' THEN NULL
  ELSE o_orderstatus END AS o_orderstatus FROM orders)
SELECT o_orderpriority, o_orderstatus, count(*) AS n FROM o GROUP BY 1, 2"""
)
def crosstab(spark, folder):
    o = table(spark, folder, "orders").withColumn(
        "o_orderstatus", F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus"))
    )
    return describe.crosstab(o, "o_orderpriority", "o_orderstatus")


@query(
    """SELECT o_orderpriority, count(*) FILTER (o_orderstatus = 'F') AS "F",
  count(*) FILTER (o_orderstatus = 'O') AS "O", count(*) FILTER (o_orderstatus = 'P') AS "P"
FROM orders GROUP BY 1"""
)
def crosstab_wide(spark, folder):
    o = table(spark, folder, "orders")
    return describe.crosstab(o, "o_orderpriority", "o_orderstatus", ["F", "O", "P"])


@query(
    """SELECT l_returnflag, count(*) AS n,
  round(avg(CAST(l_linestatus = 'O' AS INT)), 4) AS positive_share FROM lineitem GROUP BY 1"""
)
def positive_share(spark, folder):
    return describe.positive_share(table(spark, folder, "lineitem"), "l_returnflag", "l_linestatus")


@query(
    """SELECT strftime(o_orderdate, '%Y-%m') AS month, count(*) AS n FROM orders
GROUP BY 1 ORDER BY 1 LIMIT 12"""
)
def rows_per_month(spark, folder):
    return describe.rows_per_month(table(spark, folder, "orders"), "o_orderdate")


@query(
    VISITS
    + """ SELECT event_type, round(avg(value), 4) AS mean, round(stddev_samp(value), 4) AS sd,
  count(value) AS n FROM visits GROUP BY 1 HAVING count(value) > 0"""
)
def condition_stats(spark, folder):
    return describe.condition_stats(visits(spark, folder), "event_type", "value")


@query("SELECT DISTINCT o_orderpriority FROM orders WHERE o_orderpriority IS NOT NULL")
def conditions(spark, folder):
    return describe.conditions(table(spark, folder, "orders"), "o_orderpriority")


@query(
    """SELECT l_quantity AS speed_mean, l_extendedprice AS stride_mean FROM lineitem"""
)
def analysis_columns(spark, folder):
    """Columns chosen by name: means, without ratios and variation columns."""
    line = table(spark, folder, "lineitem").select(
        F.col("l_quantity").alias("speed_mean"),
        F.col("l_discount").alias("speed_mean_ratio"),
        F.col("l_tax").alias("stride_cv"),
        F.col("l_extendedprice").alias("stride_mean"),
        "l_returnflag",
    )
    return line.select(*standardise.best_numeric_columns(line))


@query(
    """SELECT event_type, count(DISTINCT user_id) AS n_users, count(*) AS n FROM events
GROUP BY event_type"""
)
def categorical_columns(spark, folder):
    """Text columns with few values, found from the data, then counted."""
    e = table(spark, folder, "events")
    cols = standardise.categorical_candidates(e.drop("props"))
    return e.groupBy(*cols).agg(F.countDistinct("user_id").alias("n_users"), F.count("*").alias("n"))


@query(
    " UNION ALL ".join(
        f"SELECT l_returnflag, '{c}' AS feature, round(quantile_cont({c}, 0.1), 4) AS p10, "
        f"round(quantile_cont({c}, 0.5), 4) AS p50, round(quantile_cont({c}, 0.99), 4) AS p99 "
        "FROM lineitem GROUP BY 1"
        for c in ("l_quantity", "l_extendedprice")
    )
)
def exact_quantiles(spark, folder):
    """Rank selection, whatever the number of distinct values."""
    from studyspark.operators.order import quantiles

    q = quantiles(
        table(spark, folder, "lineitem"),
        ["l_quantity", "l_extendedprice"],
        [0.1, 0.5, 0.99],
        by=["l_returnflag"],
        mode="select",
    )
    return q.select("l_returnflag", "feature", *[F.round(p, 4).alias(p) for p in ("p10", "p50", "p99")])


@query("SELECT o_orderkey, o_custkey, o_orderstatus FROM orders ORDER BY o_orderkey LIMIT 20")
def preview(spark, folder):
    from studyspark.operators.qc import preview as first_rows

    o = table(spark, folder, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    return first_rows(o, ["o_orderkey"])


@query(
    """WITH t AS (SELECT CASE WHEN event_type IN ('view', 'click') THEN NULL ELSE value END AS value,
  user_id, CASE WHEN event_type = 'error' THEN props END AS props FROM events)
SELECT 'value' AS "column", round(avg(CAST(value IS NULL AS INT)), 6) AS missing_share FROM t
UNION ALL SELECT 'user_id', round(avg(CAST(user_id IS NULL AS INT)), 6) FROM t
UNION ALL SELECT 'props', round(avg(CAST(props IS NULL AS INT)), 6) FROM t"""
)
def column_missingness(spark, folder):
    kind = F.col("event_type")
    e = table(spark, folder, "events").select(
        F.when(~kind.isin("view", "click"), F.col("value")).alias("value"),
        "user_id",
        F.when(kind == "error", F.col("props")).alias("props"),
    )
    got = standardise.column_missingness(e)
    return got.withColumn("missing_share", F.round("missing_share", 6))
