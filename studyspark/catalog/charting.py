"""Chart tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from studyspark.catalog.base import ORDER_MONTHS, REGISTRY, query, table
from studyspark.catalog.comparing import (
    GAIT,
    GAIT_FEATURES,
    SLOPE_FIT,
    TWO,
    _long_sql,
    gait,
    order_months,
    order_slopes,
    rank_sql,
)
from studyspark.operators import charts, compare, describe
from studyspark.operators.lineage import cut, shared_folder
from studyspark.sources import sinks


def hist_sql(src: str, value: str, bins: int, keys: str = "") -> str:
    """Even bins over the range, empty ones included; `keys` is a group column."""
    k = f"{keys}, " if keys else ""
    by = f"GROUP BY {keys}" if keys else ""
    on = f"AND c.{keys} = s.{keys}" if keys else ""
    cols = f"s.{keys}, " if keys else ""
    return f"""s AS (SELECT {k}min({value}) AS lo, max({value}) AS hi FROM {src} {by}),
w AS (SELECT {cols}{value} AS x, lo, (hi - lo) / {bins} AS step,
        CAST(least(floor(({value} - lo) / (hi - lo) * {bins}), {bins - 1}) AS INT) AS i
      FROM {src} t JOIN s ON {f't.{keys} = s.{keys}' if keys else 'true'}),
c AS (SELECT {k}i - CAST(x < lo + i * step AS INT)
        + CAST(x >= lo + (i + 1) * step AND i < {bins - 1} AS INT) AS bin, count(*) AS n
      FROM w GROUP BY ALL),
b AS (SELECT CAST(unnest(range({bins})) AS INT) AS bin)
SELECT {cols}b.bin, round(lo + (hi - lo) / {bins} * b.bin, 4) AS bin_low,
  round(lo + (hi - lo) / {bins} * (b.bin + 1), 4) AS bin_high, coalesce(c.n, 0) AS n
FROM s JOIN b ON true LEFT JOIN c ON c.bin = b.bin {on}"""


def rounded(hist):
    return hist.withColumns(
        {"bin_low": F.round("bin_low", 4), "bin_high": F.round("bin_high", 4)}
    )


@query("WITH " + hist_sql("lineitem", "l_extendedprice", 30))
def hist(spark, folder):
    return rounded(charts.histogram(table(spark, folder, "lineitem"), "l_extendedprice"))


@query("WITH " + hist_sql("events", "value", 30, "event_type"))
def hist_by_group(spark, folder):
    return rounded(charts.histogram(table(spark, folder, "events"), "value", "event_type"))


BOX = """bq AS (SELECT {g}, quantile_cont({v}, 0.25) AS q1, quantile_cont({v}, 0.5) AS q2,
  quantile_cont({v}, 0.75) AS q3 FROM {src} GROUP BY 1),
bx AS (SELECT t.{g}, {v} AS v, q1, q2, q3, {v} BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)
  AS inside FROM {src} t JOIN bq USING ({g}))"""
BOX_OUT = """ SELECT '{v}' AS feature, {g}, count(*) AS n, round(any_value(q1), 4) AS q1,
  round(any_value(q2), 4) AS median, round(any_value(q3), 4) AS q3,
  round(least(min(v) FILTER (inside), any_value(q1)), 4) AS whisker_low,
  round(greatest(max(v) FILTER (inside), any_value(q3)), 4) AS whisker_high,
  count(*) FILTER (NOT inside) AS n_fliers FROM bx GROUP BY {g}"""


@query("WITH " + (BOX + BOX_OUT).format(g="event_type", v="value", src="events"))
def box_stats(spark, folder):
    return charts.box_stats(table(spark, folder, "events"), ["value"], "event_type")


@query(
    "WITH "
    + BOX.format(g="event_type", v="value", src="events")
    + """ SELECT 'value' AS feature, event_type, v AS value, count(*) AS n FROM bx WHERE NOT inside
GROUP BY 2, 3"""
)
def box_fliers(spark, folder):
    return charts.fliers(table(spark, folder, "events"), ["value"], "event_type")


@query(
    """SELECT p_type AS value, count(*) AS n, round(100.0 * count(*) / (SELECT count(*) FROM part), 1) AS pct,
  CAST(count(*) AS VARCHAR) || ' (' || CAST(round(100.0 * count(*) / (SELECT count(*) FROM part), 1) AS VARCHAR)
  || '%)' AS label FROM part GROUP BY 1"""
)
def bar_data(spark, folder):
    counts = describe.describe_categorical(table(spark, folder, "part"), ["p_type"])
    return charts.bar_labels(counts).drop("column")


@query(
    rank_sql(_long_sql(GAIT_FEATURES, "l_linestatus", f"({GAIT})"))
    + TWO
    + """ SELECT CAST(row_number() OVER (ORDER BY effect_size, feature) AS INT) AS ord, feature,
  abs(effect_size) AS size, effect_size >= 0 AS is_positive FROM c"""
)
def effect_bars(spark, folder):
    return charts.effect_bars(
        compare.compare_groups(gait(spark, folder), GAIT_FEATURES, "l_linestatus")
    )


@query(
    ORDER_MONTHS
    + """, e AS (SELECT o_custkey, min(o_orderkey) AS k FROM om GROUP BY 1 ORDER BY 2 LIMIT 30),
g AS (SELECT o_custkey, count(*) AS n, min_by(o_orderpriority, o_orderkey) AS "group"
  FROM om WHERE o_custkey IN (SELECT o_custkey FROM e) GROUP BY 1 HAVING count(*) >= 2)
SELECT om.o_custkey, months AS time, o_totalprice AS outcome, "group" FROM om JOIN g USING (o_custkey)"""
)
def trend_series(spark, folder):
    return charts.trend_series(
        order_months(spark, folder),
        "o_custkey",
        "months",
        "o_totalprice",
        "o_orderkey",
        "o_orderpriority",
    )


@query(SLOPE_FIT + ", " + hist_sql("sl", "slope", 25))
def slope_histogram(spark, folder):
    per = cut(order_slopes(spark, folder))
    return rounded(charts.slope_distribution(per)[0])


@query(
    SLOPE_FIT
    + """, d AS (SELECT DISTINCT o_custkey, o_orderstatus AS "group" FROM orders),
j AS (SELECT d."group" AS g, slope FROM sl LEFT JOIN d USING (o_custkey)), """
    + (BOX + BOX_OUT).format(g="g", v="slope", src="j").replace("'slope' AS feature, g,", "'slope' AS feature, g AS \"group\",")
)
def slope_by_group(spark, folder):
    per = cut(order_slopes(spark, folder).where("status = 'ok'"))
    return charts.slopes_by_group(per, table(spark, folder, "orders"), "o_custkey", "o_orderstatus")


@query(REGISTRY["hist_by_group"].sql)
def sink_charts(spark, folder):
    """Chart tables as the writer leaves them."""
    path = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    sinks.write_charts({"hist": hist_by_group(spark, folder)}, path)
    return spark.read.parquet(f"{path}/plots/hist")
