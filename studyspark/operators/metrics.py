"""Scores of prediction tables, as aggregates."""

from __future__ import annotations

import math

from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from studyspark.operators.order import average_ranks, long_values, profile_values, quantiles


def _cells(pred: DataFrame, actual: str, predicted: str) -> DataFrame:
    return pred.groupBy(F.col(actual).alias("actual"), F.col(predicted).alias("predicted")).agg(
        F.count("*").alias("n")
    )


def class_scores(pred: DataFrame, actual: str = "y_true", predicted: str = "y_pred") -> DataFrame:
    """One row: n, accuracy, f1_weighted (a label never hit scores 0)."""
    zero, n = F.lit(0).cast("bigint"), F.col("n")
    hit = F.when(F.col("actual") == F.col("predicted"), n).otherwise(zero)
    sides = F.array(
        F.struct(F.col("actual").alias("y"), n.alias("s"), zero.alias("p"), hit.alias("tp")),
        F.struct(F.col("predicted").alias("y"), zero.alias("s"), n.alias("p"), zero.alias("tp")),
    )
    per = (
        _cells(pred, actual, predicted)
        .select(F.inline(sides))
        .groupBy("y")
        .agg(F.sum("s").alias("s"), F.sum("p").alias("p"), F.sum("tp").alias("tp"))
    )
    f1 = F.coalesce(F.try_divide(2.0 * F.col("tp"), F.col("s") + F.col("p")), F.lit(0.0))
    return per.agg(
        F.sum("s").alias("n"),
        F.round(F.sum("tp") / F.sum("s"), 4).alias("accuracy"),
        F.round(F.sum(F.col("s") * f1) / F.sum("s"), 4).alias("f1_weighted"),
    )


def confusion(pred: DataFrame, actual: str = "y_true", predicted: str = "y_pred") -> DataFrame:
    """(actual, predicted, n) on the full label grid, zero cells included."""
    cells = _cells(pred, actual, predicted)
    labels = cells.select(F.explode(F.array("actual", "predicted")).alias("y")).agg(
        F.array_sort(F.collect_set("y")).alias("ys")
    )
    grid = labels.select(F.explode("ys").alias("actual"), "ys").select(
        "actual", F.explode("ys").alias("predicted")
    )
    return grid.join(cells, ["actual", "predicted"], "left").select(
        "actual", "predicted", F.coalesce("n", F.lit(0)).alias("n")
    )


def roc_auc(pred: DataFrame, positive: str, score: str) -> DataFrame:
    """One row (n_positive, n_negative, auc) from average ranks; `positive` is a boolean column."""
    rows = pred.where(F.col(positive).isNotNull()).withColumn("pos", F.col(positive))
    ranked = average_ranks(
        long_values(rows, [score], ["pos"], profile_values(rows, [score])), ["pos"]
    )
    got = ranked.agg(
        F.sum(F.when(F.col("pos"), F.col("n") * F.col("rank"))).alias("r"),
        F.coalesce(F.sum(F.when(F.col("pos"), F.col("n"))), F.lit(0)).alias("n1"),
        F.coalesce(F.sum(F.when(~F.col("pos"), F.col("n"))), F.lit(0)).alias("n0"),
    )
    n1, n0 = F.col("n1").cast("double"), F.col("n0").cast("double")
    return got.select(
        F.col("n1").alias("n_positive"),
        F.col("n0").alias("n_negative"),
        F.round(F.try_divide(F.col("r") - n1 * (n1 + 1) / 2, n1 * n0), 4).alias("auc"),
    )


def regression_scores(
    pred: DataFrame, actual: str = "y_true", predicted: str = "y_pred"
) -> DataFrame:
    """One row: n, mae, rmse, r2."""
    y, err = F.col(actual), F.col(actual) - F.col(predicted)
    got = pred.agg(
        F.count(err).alias("n"),
        F.avg(F.abs(err)).alias("mae"),
        F.avg(err * err).alias("mse"),
        F.var_pop(y).alias("var"),
    )
    flat = F.when(F.col("mse") == 0, F.lit(1.0)).otherwise(0.0)
    r2 = F.when(F.col("var") == 0, flat).otherwise(1 - F.try_divide("mse", "var"))
    return got.select(
        "n",
        F.round("mae", 4).alias("mae"),
        F.round(F.sqrt("mse"), 4).alias("rmse"),
        F.round(r2, 4).alias("r2"),
    )


def calibration(pred: DataFrame, positive: str, score: str, bins: int = 10) -> DataFrame:
    """(bin, n, mean_score, observed): bins cut at the score quantiles, left-closed."""
    probs = [i / bins for i in range(1, bins)]
    cuts = quantiles(pred, [score], probs).first()
    edges = sorted({cuts[c] for c in cuts.asDict() if c != "feature"})
    cut = Bucketizer(
        inputCol="_s", outputCol="_b", splits=[-math.inf, *edges, math.inf], handleInvalid="keep"
    )
    rows = pred.select(F.col(score).cast("double").alias("_s"), F.col(positive).alias("_p"))
    return (
        cut.transform(rows.where("_s is not null"))
        .groupBy(F.col("_b").cast("int").alias("bin"))
        .agg(
            F.count("*").alias("n"),
            F.round(F.avg("_s"), 4).alias("mean_score"),
            F.round(F.avg(F.col("_p").cast("int")), 4).alias("observed"),
        )
    )
