"""The tables behind each chart."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from studyspark.functions.coerce import numeric_of
from studyspark.operators.keyed import attach
from studyspark.operators.order import long_values, quantiles
from studyspark.operators.progression import progression_summary

WHISKER = 1.5
EFFECT_LINES = (0.2, 0.5, 0.8)


def histogram(df: DataFrame, col: str, group: str | None = None, bins: int = 30) -> DataFrame:
    """(group, bin, bin_low, bin_high, n) over the data range, empty bins included.

    With `group`, every group has its own range. The last bin is closed.
    """
    keys = [group] if group else []
    rows = df.select(*keys, numeric_of(df, col).alias("_x")).where("_x is not null")
    if group:
        rows = rows.where(F.col(group).isNotNull())
    span = (rows.groupBy(*keys) if keys else rows.groupBy()).agg(
        F.min("_x").alias("_lo"), F.max("_x").alias("_hi")
    )
    flat = F.col("_lo") == F.col("_hi")
    span = span.select(
        *keys,
        F.when(flat, F.col("_lo") - 0.5).otherwise(F.col("_lo")).alias("_lo"),
        F.when(flat, F.col("_hi") + 0.5).otherwise(F.col("_hi")).alias("_hi"),
    ).where("_lo is not null")
    if keys:
        placed = attach(rows, span, keys)
        low, high = F.col("_lo"), F.col("_hi")
    else:
        # one range for the table: scanned once, then a literal
        span = df.sparkSession.createDataFrame(span.collect(), span.schema)
        one = span.first()
        placed = rows
        low, high = (F.lit(one[c] if one else None).cast("double") for c in ("_lo", "_hi"))
    width = (high - low) / bins
    at = F.least(F.floor((F.col("_x") - low) / (high - low) * bins), F.lit(bins - 1)).cast("int")
    # rounding may put a value on the wrong side of its edge by one bin
    near = placed.withColumn("_at", at)
    below = F.col("_x") < low + F.col("_at") * width
    beyond = (F.col("_x") >= low + (F.col("_at") + 1) * width) & (F.col("_at") < bins - 1)
    fixed = F.col("_at") - below.cast("int") + beyond.cast("int")
    counts = near.groupBy(*keys, fixed.alias("bin")).agg(F.count("*").alias("_n"))
    grid = span.withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    step = (F.col("_hi") - F.col("_lo")) / bins
    return grid.join(counts, [*keys, "bin"], "left").select(
        *keys,
        "bin",
        (F.col("_lo") + step * F.col("bin")).alias("bin_low"),
        (F.col("_lo") + step * (F.col("bin") + 1)).alias("bin_high"),
        F.coalesce("_n", F.lit(0)).alias("n"),
    )


def _fenced(df: DataFrame, features: Sequence[str], group: str | None) -> DataFrame:
    """Long values with quartiles and fences of their box."""
    keys = [group] if group else []
    rows = df.where(F.col(group).isNotNull()) if group else df
    q = quantiles(rows, features, [0.25, 0.5, 0.75], by=keys)
    reach = WHISKER * (F.col("p75") - F.col("p25"))
    fences = q.withColumn("_lo", F.col("p25") - reach).withColumn("_hi", F.col("p75") + reach)
    return attach(long_values(rows, features, keys), fences, [*keys, "feature"])


def box_stats(df: DataFrame, features: Sequence[str], group: str | None = None) -> DataFrame:
    """(feature, group, n, q1, median, q3, whisker_low, whisker_high, n_fliers) per box."""
    keys = [group] if group else []
    x = F.col("value")
    inside = (x >= F.col("_lo")) & (x <= F.col("_hi"))
    per = (
        _fenced(df, [f for f in features if f in df.columns], group)
        .groupBy("feature", *keys)
        .agg(
            F.count("*").alias("n"),
            F.max("p25").alias("q1"),
            F.max("p50").alias("median"),
            F.max("p75").alias("q3"),
            F.min(F.when(inside, x)).alias("_wl"),
            F.max(F.when(inside, x)).alias("_wh"),
            F.count(F.when(~inside, 1)).alias("n_fliers"),
        )
    )
    return per.select(
        "feature",
        *keys,
        "n",
        F.round("q1", 4).alias("q1"),
        F.round("median", 4).alias("median"),
        F.round("q3", 4).alias("q3"),
        F.round(F.least("_wl", "q1"), 4).alias("whisker_low"),
        F.round(F.greatest("_wh", "q3"), 4).alias("whisker_high"),
        "n_fliers",
    )


def fliers(df: DataFrame, features: Sequence[str], group: str | None = None) -> DataFrame:
    """(feature, group, value, n): all values beyond the fences, equal values folded."""
    keys = [group] if group else []
    x = F.col("value")
    return (
        _fenced(df, [f for f in features if f in df.columns], group)
        .where((x < F.col("_lo")) | (x > F.col("_hi")))
        .groupBy("feature", *keys, "value")
        .agg(F.count("*").alias("n"))
    )


def bar_labels(counts: DataFrame) -> DataFrame:
    """Value counts with the text shown at each bar."""
    label = F.concat(F.col("n").cast("string"), F.lit(" ("), F.col("pct").cast("string"), F.lit("%)"))
    return counts.withColumn("label", label)


def effect_bars(cmp: DataFrame) -> DataFrame:
    """(ord, feature, size, is_positive), ascending by signed effect, NULL effects left out.

    `ord` is over one row per compared feature.
    """
    from pyspark.sql.window import Window

    by_effect = Window.orderBy("effect_size", "feature")
    return cmp.where(F.col("effect_size").isNotNull()).select(
        F.row_number().over(by_effect).alias("ord"),
        "feature",
        F.abs("effect_size").alias("size"),
        (F.col("effect_size") >= 0).alias("is_positive"),
    )


def trend_series(
    df: DataFrame,
    entity: str,
    time: str,
    outcome: str,
    order_col: str,
    group: str | None = None,
    max_entities: int = 30,
) -> DataFrame:
    """(entity, time, outcome, group) of the first entities with at least two complete points.

    Entities count in order of first appearance; the group is the first non-null one.
    """
    rows = df.where(F.col(entity).isNotNull())
    shown = (
        rows.groupBy(F.col(entity).alias("_e"))
        .agg(F.min(order_col).alias("_first"))
        .orderBy("_first")
        .limit(max_entities)
        .select("_e")
    )
    # never more than max_entities rows
    few = rows.join(F.broadcast(shown), F.col(entity) == F.col("_e"), "left_semi")
    points = few.select(
        entity,
        order_col,
        numeric_of(df, time).alias("time"),
        numeric_of(df, outcome).alias("outcome"),
        *([F.col(group).alias("_g")] if group else []),
    )
    complete = F.col("time").isNotNull() & F.col("outcome").isNotNull()
    aggs = [F.count(F.when(complete, 1)).alias("_points")]
    if group:
        seen = F.when(F.col("_g").isNotNull(), F.col(order_col))
        aggs.append(F.min_by("_g", seen).alias("group"))
    per = points.groupBy(F.col(entity).alias("_e")).agg(*aggs).where("_points >= 2")
    return (
        points.where(complete)
        .join(F.broadcast(per), F.col(entity) == F.col("_e"))
        .select(entity, "time", "outcome", *(["group"] if group else []))
    )


def slope_distribution(per_entity: DataFrame, bins: int = 25) -> tuple[DataFrame, DataFrame]:
    """Histogram of the slopes and the one-row summary with median and upper quartile."""
    return histogram(per_entity, "slope", bins=bins), progression_summary(per_entity)


def slope_groups(per_entity: DataFrame, df: DataFrame, entity: str, group: str) -> DataFrame:
    """Slopes with each distinct group of their entity (several rows if it has several)."""
    pairs = df.select(F.col(entity).alias("_e"), F.col(group).alias("group")).distinct()
    return per_entity.join(pairs, F.col(entity) == F.col("_e"), "left").drop("_e")


def slopes_by_group(per_entity: DataFrame, df: DataFrame, entity: str, group: str) -> DataFrame:
    """Box statistics of the slopes in each group."""
    return box_stats(slope_groups(per_entity, df, entity, group), ["slope"], "group")
