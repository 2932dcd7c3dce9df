"""Ridge regression from sums: all folds from one pass, and text features of any number of levels.

The normal equations need only sums of products. Sums per fold give every fold's training part as
all less the fold. For a text feature each level's coefficient follows from the others, so levels are
eliminated one by one where they lie: what reaches the driver is a matrix of the numeric features, and
the coefficients of levels stay a table, though there be as many levels as rows.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from studyspark.functions.coerce import numeric_of
from studyspark.operators.keyed import attach
from studyspark.operators.lineage import cut


def _products(columns: Sequence[Column], scale: Column | None = None) -> list[Column]:
    """Sums of all products of two columns, the upper triangle row by row."""
    out = []
    for i, a in enumerate(columns):
        for j, b in enumerate(columns[i:], i):
            term = a * b if scale is None else a * b / scale
            out.append(F.sum(term).alias(f"p{i}_{j}"))
    return out


def _square(row, n: int) -> np.ndarray:
    out = np.zeros((n, n))
    for i in range(n):
        for j in range(i, n):
            out[i, j] = out[j, i] = row[f"p{i}_{j}"] or 0.0
    return out


def _solved(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.linalg.lstsq(a, b, rcond=None)[0]


def ridge_by_folds(
    rows: DataFrame, features: Sequence[str], folds: int, alpha: float, least_train: int, least_test: int
) -> list[tuple[int, float, float, float]] | None:
    """(fold, mae, rmse, r2) of rows (_fold, _label, features..): each fold is the test part once.

    Standardised features, an intercept without penalty. None where a feature has a gap, as values to
    fill it with differ by fold. Folds with fewer rows than the bounds are left out.
    """
    names = list(features)
    means = rows.agg(
        F.count(F.lit(1)).alias("n"),
        F.avg("_label").alias("y"),
        *[F.count(c).alias(f"n_{i}") for i, c in enumerate(names)],
        *[F.avg(c).alias(f"m_{i}") for i, c in enumerate(names)],
    ).first()
    if any(means[f"n_{i}"] < means["n"] for i in range(len(names))):
        return None
    if not means["n"]:
        return []
    # from the means of all rows, so that sums of squares stay small
    centre = [means[f"m_{i}"] for i in range(len(names))]
    one = F.lit(1.0)
    columns = [one, *[F.col(c) - F.lit(m) for c, m in zip(names, centre)], F.col("_label") - F.lit(means["y"])]
    sums = {r["_fold"]: _square(r, len(columns)) for r in rows.groupBy("_fold").agg(*_products(columns)).collect()}
    total = sum(sums.values())
    pred = F.when(F.lit(False), F.lit(0.0))
    scored = []
    for fold in range(folds):
        train = total - sums.get(fold, 0.0)
        n, held = train[0, 0], total[0, 0] - train[0, 0]
        if n < least_train or held < least_test:
            continue
        mean = train[0, 1:] / n
        spread = train[1:, 1:] / n - np.outer(mean, mean)
        sd = np.sqrt(np.maximum(np.diag(spread)[:-1], 0))
        used = np.flatnonzero(sd > 1e-12 * (1 + np.abs(mean[:-1])))
        z = n * spread[np.ix_(used, used)] / np.outer(sd[used], sd[used])
        w = np.zeros(len(names))
        w[used] = _solved(z + alpha * np.eye(len(used)), n * spread[used, -1] / sd[used]) / sd[used]
        at = F.lit(float(means["y"] + mean[-1] - w @ (mean[:-1] + centre)))
        for c, weight in zip(names, w):
            at = at + F.lit(float(weight)) * F.col(c)
        pred = pred.when(F.col("_fold") == fold, at)
        scored.append(fold)
    off = F.col("_label") - pred
    got = (
        rows.where(F.col("_fold").isin(scored) if scored else F.lit(False))
        .groupBy("_fold")
        .agg(F.avg(F.abs(off)).alias("mae"), F.avg(off * off).alias("mse"), F.var_pop("_label").alias("var"))
        .orderBy("_fold")
    )
    flat = F.when(F.col("mse") == 0, F.lit(1.0)).otherwise(0.0)
    r2 = F.when(F.col("var") == 0, flat).otherwise(1 - F.try_divide("mse", "var"))
    shown = got.select("_fold", F.round("mae", 4).alias("mae"), F.round(F.sqrt("mse"), 4).alias("rmse"), F.round(r2, 4).alias("r2"))
    return [tuple(r) for r in shown.collect()]


@dataclass(frozen=True)
class LevelRidge:
    """`weights` of the numeric features and the intercept; `levels` has (level, n, coef)."""

    features: tuple[str, ...]
    text: str
    intercept: float
    weights: tuple[float, ...]
    levels: DataFrame

    def predict(self, df: DataFrame) -> DataFrame:
        """Adds `_pred`; a missing, first or unseen level adds nothing, a missing number counts as the
        mean of the training rows would: use complete rows."""
        at = F.lit(self.intercept)
        for c, w in zip(self.features, self.weights):
            at = at + F.lit(w) * numeric_of(df, c)
        coefs = self.levels.select(F.col("level").alias("_level"), F.col("coef").alias("_coef"))
        both = attach(df.withColumn("_level", F.col(f"`{self.text}`")), coefs, ["_level"], broadcast_bytes=0)
        return both.withColumn("_pred", at + F.coalesce("_coef", F.lit(0.0))).drop("_level", "_coef")


def ridge_with_levels(
    df: DataFrame, features: Sequence[str], text: str, target: str, alpha: float = 1.0
) -> LevelRidge:
    """Ridge on standardised numeric features and the standardised indicators of each level of `text`
    but the first one in order; null counts as the first. The same as with the indicators as columns.

    Rows without the target or a numeric feature are left out. An empty table gives zero weights.
    """
    names = list(features)
    rows = df.select(
        F.col(f"`{text}`").alias("level"), *[numeric_of(df, c).alias(f"x{i}") for i, c in enumerate(names)], numeric_of(df, target).alias("y")
    ).dropna(subset=[*[f"x{i}" for i in range(len(names))], "y"])
    rows = cut(rows)
    stats = rows.agg(
        F.count(F.lit(1)).alias("n"), F.min("level").alias("first"), F.avg("y").alias("y"),
        *[F.avg(f"x{i}").alias(f"m{i}") for i in range(len(names))],
        *[F.stddev_pop(f"x{i}").alias(f"s{i}") for i in range(len(names))],
    ).first()
    n = stats["n"]
    means = [stats[f"m{i}"] or 0.0 for i in range(len(names))]
    sds = [stats[f"s{i}"] or 0.0 for i in range(len(names))]
    y_mean = stats["y"] or 0.0
    one = F.lit(1.0)
    z = [(F.col(f"x{i}") - F.lit(m)) / F.lit(s) if s else F.lit(0.0) for i, (m, s) in enumerate(zip(means, sds))]
    columns = [one, *z, F.col("y") - F.lit(y_mean)]
    size = len(columns)
    whole = _square(rows.agg(*_products(columns)).first(), size)
    # per level: sums of the row vector, whose product over n + alpha s^2 is what elimination takes off
    per_level = rows.where(F.col("level") != F.lit(stats["first"])) if stats["first"] is not None else rows.where(F.lit(False))
    share = F.col("n") / F.lit(float(max(n, 1)))
    levels = cut(
        per_level.groupBy("level")
        .agg(F.count(F.lit(1)).alias("n"), *[F.sum(c).alias(f"q{i}") for i, c in enumerate(columns)])
        .withColumn("weight", F.col("n") + F.lit(alpha) * share * (1 - share))
    )
    taken = _square(levels.agg(*_products([F.col(f"q{i}") for i in range(size)], F.col("weight"))).first(), size)
    left = whole - taken
    penalty = np.diag([0.0, *[alpha] * len(names)])
    theta = _solved(left[:-1, :-1] + penalty, left[:-1, -1])
    fitted: Column = F.lit(0.0)
    for i, t in enumerate(theta):
        fitted = fitted + F.lit(float(t)) * F.col(f"q{i}")
    coefs = levels.select("level", "n", ((F.col(f"q{size - 1}") - fitted) / F.col("weight")).alias("coef"))
    weights = [float(t / s) if s else 0.0 for t, s in zip(theta[1:], sds)]
    intercept = y_mean + float(theta[0]) - sum(w * m for w, m in zip(weights, means))
    return LevelRidge(tuple(names), text, float(intercept), tuple(weights), coefs)
