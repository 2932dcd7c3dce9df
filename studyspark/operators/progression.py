"""Per-entity linear trends and their summary."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from studyspark.functions.coerce import numeric_of
from studyspark.functions.tails import student_two_sided
from studyspark.operators.lineage import cut
from studyspark.operators.order import quantiles
from studyspark.operators.standardise import months_since_baseline

MIN_VISITS = 3
TINY = 1e-20


def slopes(
    df: DataFrame, entity: str, time: str, outcome: str, min_visits: int = MIN_VISITS
) -> DataFrame:
    """(entity, slope, intercept, r2, p_value, n_visits, status) for entities with enough visits.

    One aggregate of partial moments: a hot entity combines on the map side. An entity measured at
    one time only keeps its row with NULL slope and status 'constant_time'.
    """
    x, y = numeric_of(df, time), numeric_of(df, outcome)
    both = df.where(F.col(entity).isNotNull()).select(entity, x.alias("_x"), y.alias("_y"))
    fit = (
        both.where("_x is not null and _y is not null")
        .groupBy(entity)
        .agg(
            F.regr_slope("_y", "_x").alias("_slope"),
            F.regr_intercept("_y", "_x").alias("_icept"),
            F.regr_r2("_y", "_x").alias("_r2"),
            F.count("*").alias("n_visits"),
            F.var_pop("_x").alias("_vx"),
            F.var_pop("_y").alias("_vy"),
        )
        .where(F.col("n_visits") >= min_visits)
    )
    r2 = F.when(F.col("_vy") == 0, F.lit(0.0)).otherwise(F.least("_r2", F.lit(1.0)))
    r = F.sqrt(r2)
    dof = F.col("n_visits") - 2
    t = r * F.sqrt(dof / ((1 - r + TINY) * (1 + r + TINY)))
    moving = F.col("_vx") > 0
    return fit.select(
        entity,
        F.round(F.when(moving, F.col("_slope")), 6).alias("slope"),
        F.round(F.when(moving, F.col("_icept")), 4).alias("intercept"),
        F.round(F.when(moving, r2), 4).alias("r2"),
        F.round(F.when(moving, student_two_sided(t, dof)), 4).alias("p_value"),
        "n_visits",
        F.when(moving, F.lit("ok")).otherwise(F.lit("constant_time")).alias("status"),
    )


def slopes_by_months(
    df: DataFrame, entity: str, time: str, outcome: str, **parse
) -> DataFrame:
    """Slopes per month since each entity's first visit."""
    return slopes(months_since_baseline(df, entity, time, "_months", **parse), entity, "_months", outcome)


def _quartiles(per_entity: DataFrame) -> tuple[float | None, float | None]:
    row = quantiles(per_entity, ["slope"], [0.5, 0.75]).first()
    return (row["p50"], row["p75"]) if row else (None, None)


def progression_summary(per_entity: DataFrame) -> DataFrame:
    """One row: n_subjects, mean, median, sd, threshold (upper quartile), fast count and share.

    The slopes are written once as one column; the passes below read that.
    """
    per_entity = cut(per_entity.select("slope"))
    median, q75 = _quartiles(per_entity)
    fast = F.count(F.when(F.col("slope") >= F.lit(q75), 1))
    n = F.count("slope")
    return per_entity.agg(
        n.alias("n_subjects"),
        F.round(F.avg("slope"), 6).alias("mean_slope"),
        F.round(F.lit(median).cast("double"), 6).alias("median_slope"),
        F.round(F.stddev_samp("slope"), 6).alias("sd_slope"),
        F.round(F.lit(q75).cast("double"), 6).alias("fast_progressor_threshold"),
        fast.alias("n_fast_progressors"),
        F.round(100.0 * F.try_divide(fast, n), 1).alias("pct_fast"),
    )


def fast_progressors(per_entity: DataFrame) -> DataFrame:
    """Slopes with is_fast = slope at or above the upper quartile."""
    per_entity = cut(per_entity)
    _, q75 = _quartiles(per_entity)
    return per_entity.withColumn(
        "is_fast", F.coalesce(F.col("slope") >= F.lit(q75).cast("double"), F.lit(False))
    )
