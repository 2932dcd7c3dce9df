import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from studyspark.operators import keyed, order


@pytest.fixture(scope="module")
def skewed(spark):
    """Ties, a value holding a third of the rows, an uneven group."""
    rng = np.random.default_rng(3)
    x = np.concatenate([np.zeros(700), np.round(rng.lognormal(0, 2, 1300), 2)])
    pdf = pd.DataFrame({"x": x, "y": rng.integers(0, 5, 2000).astype(float), "g": np.where(rng.random(2000) < 0.1, "a", "b")})
    pdf.loc[::17, "x"] = None
    return pdf, spark.createDataFrame(pdf).withColumn("x", F.expr("nullif(x, double('NaN'))")).repartition(6)


@pytest.mark.parametrize("mode", ["exact", "select"])
def test_quantiles(skewed, mode):
    pdf, df = skewed
    probs = [0, 0.1, 0.25, 0.5, 0.9, 1]
    got = {r["feature"]: r for r in order.quantiles(df, ["x", "y"], probs, mode=mode).collect()}
    for c in "xy":
        want = np.quantile(pdf[c].dropna(), probs)
        assert list(got[c])[1:] == pytest.approx(list(want), rel=1e-9)


@pytest.mark.parametrize("mode", ["exact", "select"])
def test_grouped_quantiles(skewed, mode):
    pdf, df = skewed
    rows = order.quantiles(df, ["x"], [0.25, 0.75], by=["g"], mode=mode).collect()
    for r in rows:
        want = np.quantile(pdf[pdf.g == r["g"]].x.dropna(), [0.25, 0.75])
        assert [r["p25"], r["p75"]] == pytest.approx(list(want), rel=1e-9)


def test_approx_quantiles_are_near(skewed):
    pdf, df = skewed
    got = order.quantiles(df, ["x"], [0.5], mode="approx").first()["p50"]
    assert got == pytest.approx(np.quantile(pdf.x.dropna(), 0.5), abs=0.1)


def test_average_ranks(skewed):
    pdf, df = skewed
    p = order.profile_values(df, ["x", "y"])
    got = order.average_ranks(order.long_values(df, ["x", "y"], ["g"], p), ["g"])
    sums = {(r["feature"], r["g"]): r["s"] for r in got.groupBy("feature", "g").agg(F.sum(F.expr("n * rank")).alias("s")).collect()}
    for c in "xy":
        rank = pdf[c].rank()
        for g in "ab":
            assert sums[c, g] == pytest.approx(rank[pdf.g == g].sum())


def test_constant_and_empty_columns(spark):
    df = spark.createDataFrame([(1.0, None)] * 5, "a double, b double")
    got = order.quantiles(df, ["a", "b"], [0.5], mode="select").collect()
    assert [(r["feature"], r["p50"]) for r in got] == [("a", 1.0)]


def test_attach_ways_agree(spark):
    """Broadcast, plain and salted joins give the same rows; NULL keys match each other."""
    df = spark.range(3000).select(
        "id", F.when(F.col("id") < 1500, 7).when(F.col("id") > 2900, None).otherwise(F.col("id") % 40).alias("k")
    )
    per = df.groupBy("k").agg(F.min("id").alias("first"))
    hot = keyed.profile_keys(df, ["k"], hot_min_rows=90)
    assert len(hot.hot) == 2  # the repeated key and the missing one
    cold = keyed.KeyProfile(hot.rows, hot.distinct, hot.key_bytes, ())
    ways = [
        keyed.attach(df, per, ["k"]),
        keyed.attach(df, per, ["k"], cold, broadcast_bytes=0),
        keyed.attach(df, per, ["k"], hot, broadcast_bytes=0, salts=8),
    ]
    rows = [sorted((r["id"], r["k"], r["first"]) for r in w.collect()) for w in ways]
    assert rows[0] == rows[1] == rows[2]
    assert len(rows[0]) == 3000 and all(r[2] is not None for r in rows[0])


def test_salted_plan_spreads_the_hot_key(spark):
    df = spark.range(4000).select("id", F.when(F.col("id") < 3000, 7).otherwise(F.col("id")).alias("k"))
    per = df.groupBy("k").agg(F.min("id").alias("first"))
    hot = keyed.profile_keys(df, ["k"], hot_min_rows=100)
    out = keyed.attach(df, per, ["k"], hot, broadcast_bytes=0, salts=16)
    assert "_salt" in out._jdf.queryExecution().optimizedPlan().toString()
    assert out.where("k = 7 and first = 0").count() == 3000
