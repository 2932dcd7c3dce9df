"""Ridge from sums against dense matrices."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from studyspark.operators import describe, models
from studyspark.operators.ridge import ridge_by_folds, ridge_with_levels


def dense(x, y, alpha=1.0):
    """Intercept and raw weights of ridge on standardised columns."""
    mean, sd = x.mean(0), x.std(0)
    sd = np.where(sd == 0, 1, sd)
    z = (x - mean) / sd
    w = np.linalg.solve(z.T @ z + alpha * np.eye(x.shape[1]), z.T @ (y - y.mean())) / sd
    return y.mean() - w @ mean, w


@pytest.fixture(scope="module")
def made():
    rng = np.random.default_rng(5)
    n = 400
    x = rng.normal(size=(n, 2)) * [3, 0.1] + [1e4, -2]
    level = rng.choice([f"l{k:02d}" for k in range(30)], n)
    level[:130] = "hot"  # a third of all rows
    effect = {v: rng.normal() for v in sorted(set(level))}
    y = x @ [0.5, 4] + np.array([effect[v] for v in level]) + rng.normal(size=n) * 0.3
    return x, level, y


def test_levels_are_eliminated_exactly(spark, made):
    x, level, y = made
    text = [None if k % 29 == 0 else str(v) for k, v in enumerate(level)]
    rows = [(*map(float, r), t, float(v)) for r, t, v in zip(x, text, y)]
    rows += [(None, 1.0, "l01", 2.0), (1.0, 1.0, "l02", None)]
    df = spark.createDataFrame(rows, "a double, b double, t string, y double")
    fit = ridge_with_levels(df, ["a", "b"], "t", "y")
    names = sorted({t for t in text if t})[1:]
    ones = np.array([[float(t == v) for v in names] for t in text])
    intercept, w = dense(np.hstack([x, ones]), y)
    assert fit.weights == pytest.approx(w[:2], rel=1e-6) and fit.intercept == pytest.approx(intercept, rel=1e-6)
    assert {r["level"]: r["coef"] for r in fit.levels.collect()} == pytest.approx(dict(zip(names, w[2:])), abs=1e-6)
    got = {r["k"]: r["_pred"] for r in fit.predict(df.limit(400).withColumn("k", F.monotonically_increasing_id())).collect()}
    want = intercept + np.hstack([x, ones]) @ w
    assert sorted(got.values()) == pytest.approx(sorted(want), abs=1e-5)


def test_as_many_levels_as_rows(spark):
    df = spark.range(3000).select(F.col("id").cast("string").alias("t"), (F.col("id") % 7).alias("a"), (F.col("id") % 7 * 2.0).alias("y"))
    fit = ridge_with_levels(df, ["a"], "t", "y")
    assert fit.levels.count() == 2999 and fit.weights[0] > 0
    assert ridge_with_levels(df.limit(0), ["a"], "t", "y").weights == (0.0,)


def test_folds_from_one_pass(spark, made):
    x, _, y = made
    fold = np.arange(len(y)) % 3
    fold[:4] = 3  # too few test rows
    rows = [(int(f), *map(float, r), 5.0, float(v)) for f, r, v in zip(fold, x, y)]
    df = spark.createDataFrame(rows, "_fold int, a double, b double, flat double, _label double")
    got = ridge_by_folds(df, ["a", "b", "flat"], 4, 1.0, 10, 5)
    assert [r[0] for r in got] == [0, 1, 2]
    for f, mae, rmse, r2 in got:
        train = fold != f
        intercept, w = dense(x[train], y[train])
        off = y[~train] - intercept - x[~train] @ w
        assert (mae, rmse) == (pytest.approx(abs(off).mean(), abs=1e-4), pytest.approx((off**2).mean() ** 0.5, abs=1e-4))
        assert r2 == pytest.approx(1 - (off**2).mean() / y[~train].var(), abs=1e-4)
    gap = df.withColumn("a", F.when(F.col("b") > -2, F.col("a")))
    assert ridge_by_folds(gap, ["a", "b"], 4, 1.0, 10, 5) is None
    assert ridge_by_folds(df.limit(0), ["a"], 4, 1.0, 10, 5) == []


def test_guards_on_classes_and_levels(spark):
    df = spark.range(11_000).select(
        "id", F.col("id").cast("string").alias("name"), (F.col("id") % 400).cast("double").alias("many"),
        F.when(F.col("id") % 2 == 0, "p").otherwise("q").alias("y"), (F.col("id") % 9).alias("x"),
    )
    many = models.run_classification(df, "many", "id", ["x"], models=[models.LOGISTIC], importance=False)
    assert "more than 200 classes" in many.error
    wide = models.run_classification(df, "y", "id", ["x", "name"], models=[models.LOGISTIC], importance=False)
    assert wide.error is None and list(wide.errors) == ["name"] and wide.summary["features"] == ["x"]
    none = models.run_regression(df, "x", "id", ["name"], models=[models.RIDGE], importance=False)
    assert none.error and "name" in none.errors


def test_duplicates_by_fingerprint(spark):
    rows = [(None, "a"), ("a", None), ("a", None), ("", "a"), ("a", ""), (None, None), (None, None), (None, None)]
    df = spark.createDataFrame(rows, "x string, `y.z` string")
    assert tuple(describe.profile_totals(df).first()) == (8, 2, 3)
    assert tuple(describe.profile_totals(df.limit(0)).first()) == (0, 2, 0)
    assert tuple(describe.profile_totals(spark.range(1000)).first()) == (1000, 1, 0)
