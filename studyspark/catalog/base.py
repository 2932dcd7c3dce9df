"""Registry and shared inputs."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Query:
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None


REGISTRY: dict[str, Query] = {}


def query(sql: str | None = None):
    """Register a function under its own name."""

    def add(fn):
        REGISTRY[fn.__name__] = Query(fn, sql)
        return fn

    return add


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


# Events as visits: signups carry no measured value.
VISITS = """WITH visits AS (
  SELECT event_id, ts, user_id, event_type, props, CAST(ts AS DATE) AS day,
         CASE WHEN event_type = 'signup' THEN NULL ELSE value END AS value
  FROM events)"""


def visits(spark: SparkSession, folder: str) -> DataFrame:
    return (
        table(spark, folder, "events")
        .withColumn("day", F.to_date("ts"))
        .withColumn("value", F.when(F.col("event_type") != "signup", F.col("value")))
    )


# Orders on a month axis since the first order of the customer.
ORDER_MONTHS = """WITH om AS (
  SELECT o_orderkey, o_custkey, o_totalprice, o_orderpriority, o_orderstatus,
         round(date_diff('microsecond', min(o_orderdate) OVER (PARTITION BY o_custkey), o_orderdate)
               / 1e6 / 86400 / 30.44, 2) AS months
  FROM orders)"""


def sql_erfc(x: str) -> str:
    """The same published erfc fit, as SQL text."""
    from studyspark.functions.tails import ERFC

    t = f"(1.0 / (1.0 + 0.5 * ({x})))"
    poly = repr(ERFC[-1])
    for c in reversed(ERFC[:-1]):
        poly = f"({c!r} + {t} * {poly})"
    return f"({t} * exp(-({x}) * ({x}) + {poly}))"


def sql_normal_two_sided(z: str) -> str:
    return f"least({sql_erfc(f'abs({z}) / sqrt(2.0)')}, 1.0)"
