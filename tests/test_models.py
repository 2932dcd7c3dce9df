import inspect

import numpy as np
import pytest
from pyspark.sql import functions as F

from studyspark.operators import metrics, models, splits
from studyspark.plans.report import model_facts


@pytest.fixture(scope="module")
def sample(spark):
    rng = np.random.default_rng(0)
    n = 300
    a, b = rng.normal(size=n), rng.normal(size=n) * 3 + 1
    c = rng.choice(["red", "green", "blue"], n)
    y = (a + 0.5 * (c == "red") + rng.normal(size=n) * 0.7 > 0).astype(int)
    z = 2 * a - b + rng.normal(size=n)
    rows = [
        (i, float(a[i]) if i % 19 else None, float(b[i]), str(c[i]) if i % 23 else None, "yes" if y[i] else "no", float(z[i]), i % 30, float(i))
        for i in range(n)
    ]
    return spark.createDataFrame(rows, "id bigint, a double, b double, c string, y string, z double, e int, t double").cache()


def design(rows, cols, impute):
    x = []
    for r in rows:
        v = [r[c] if r[c] is not None else impute[c] for c in cols if c != "c"]
        if "c" in cols:
            v += [float(r["c"] == lv) for lv in ("green", "red")]
        x.append(v)
    return np.array(x)


def train_rows(sample, stratum=None):
    s = splits.random_split(sample, "id", stratum=stratum)
    return s.where("split = 'train'").collect(), s.where("split = 'test'").collect()


def test_logistic_is_at_the_optimum(sample):
    """Gradient of the penalised loss on standardised features, one-hot with the first level dropped."""
    run = models.run_classification(sample, "y", "id", ["a", "b", "c"], models=[models.LOGISTIC], importance=False)
    train, _ = train_rows(sample, "y")
    impute = models.medians(splits.random_split(sample, "id", stratum="y").where("split = 'train'"), ["a", "b"])
    x = design(train, ["a", "b", "c"], impute)
    z = (x - x.mean(0)) / x.std(0)
    y = np.array([r["y"] == "yes" for r in train], float)
    fit = run.models[models.LOGISTIC].stages[-1]
    names = models.slot_names(run.models[models.LOGISTIC].transform(sample.withColumn("_label", F.lit(0.0)).limit(1)))
    assert names[:2] == ["a", "b"] and len(names) == 4
    order = {"a": 0, "b": 1}
    for i, nm in enumerate(names[2:]):
        order[nm] = 2 + ["green", "red"].index(nm.split("_")[-1])
    cols = [order[nm] for nm in names]
    # the model scales by the sample sd
    w = fit.coefficients.toArray() * np.sqrt((len(y) - 1) / len(y))
    p = 1 / (1 + np.exp(-(z[:, cols] @ w + fit.intercept)))
    grad = z[:, cols].T @ (p - y) + w
    assert np.abs(grad).max() < 1e-3


def test_ridge_closed_form(sample):
    run = models.run_regression(sample, "z", "id", ["a", "b"], models=[models.RIDGE], importance=False)
    train, test = train_rows(sample)
    impute = models.medians(splits.random_split(sample, "id").where("split = 'train'"), ["a", "b"])
    x, y = design(train, ["a", "b"], impute), np.array([r["z"] for r in train])
    mu, sd = x.mean(0), x.std(0)
    zx = (x - mu) / sd
    w = np.linalg.solve(zx.T @ zx + np.eye(2), zx.T @ (y - y.mean()))
    want = {r["id"]: (design([r], ["a", "b"], impute) - mu) / sd @ w + y.mean() for r in test}
    got = {r["row_key"]: r["y_pred"] for r in run.predictions[models.RIDGE].collect()}
    assert got.keys() == want.keys()
    assert all(got[k] == pytest.approx(want[k][0], abs=1e-6) for k in got)


def test_classification_tables(sample, spark, tmp_path):
    run = models.run_classification(sample, "y", "id", ["a", "b", "c"], trees=10, depth=5, repeats=2)
    m = {(r["model"], r["metric"]): r["value"] for r in run.metrics.collect()}
    assert {k[1] for k in m} == {"accuracy", "f1_weighted", "auc"}
    assert m[models.LOGISTIC, "auc"] > 0.75
    cells = run.confusion.where(F.col("model") == models.LOGISTIC).collect()
    assert len(cells) == 4 and sum(c["n"] for c in cells) == run.summary["n_test"]
    top = run.importance.where("ord = 1").collect()
    assert {r["feature"] for r in top} == {"a"}
    assert run.summary["best_model"] in (models.LOGISTIC, models.FOREST)
    facts = {(r["section"], r["key"]): r["value"] for r in model_facts(spark, run).collect()}
    assert facts["model", "task"] == "classification"
    run.save(str(tmp_path))
    assert spark.read.parquet(str(tmp_path / "metrics")).count() == 6


def test_guards(sample, spark):
    one = models.run_classification(sample.withColumn("y", F.lit("x")), "y", "id", ["a"])
    assert one.error == "The target needs at least two classes."
    few = models.run_regression(sample.where("id < 12"), "z", "id", ["a"])
    assert few.error.startswith("One part of the split is too small")
    assert {r["key"] for r in model_facts(spark, few).collect()} == {"task", "error"}


def test_entity_and_time_runs(sample):
    by_e = models.run_regression(sample, "z", "id", ["a", "b"], entity="e", models=[models.RIDGE], importance=False)
    assert by_e.summary["split_type"] == "entity-disjoint"
    by_t = models.run_regression(sample, "z", "id", ["a", "b"], time_col="t", models=[models.RIDGE], importance=False)
    assert by_t.summary["split_type"] == "time-based"
    assert (by_t.summary["n_train"], by_t.summary["n_test"]) == (240, 60)
    assert {r["row_key"] for r in by_t.predictions[models.RIDGE].collect()} == set(range(240, 300))


def test_permutation_of_a_useless_feature(sample):
    run = models.run_regression(sample, "z", "id", ["a", "b", "t"], models=[models.RIDGE], repeats=3)
    got = {r["feature"]: r["importance"] for r in run.importance.collect()}
    assert got["b"] > got["a"] > 0.1 and abs(got["t"]) < 0.05


def test_task_choice(sample):
    assert models.choose_task(sample, "y", "z") == ("classification", "y")
    assert models.choose_task(sample.withColumn("y", F.lit(None).cast("string")), "y", "z") == ("regression", "z")
    with pytest.raises(ValueError):
        models.choose_task(sample, None, None)
    assert models.rare_class_warning({"a": 4, "b": 90}, 94) and not models.rare_class_warning({"a": 4}, 500)


def test_time_split_with_ties(spark):
    df = spark.createDataFrame([(i, None if i % 10 == 3 else float(i // 40)) for i in range(200)], "k int, t double")
    for share in (0.2, 0.05, 0.5, 1.0):
        got = splits.time_split(df, "t", "k", share).collect()
        ranked = sorted(got, key=lambda r: (r["t"] is None, r["t"] or 0, r["k"]))
        cut = int(200 * (1 - share))
        assert {r["k"] for r in got if r["split"] == "train"} == {r["k"] for r in ranked[:cut]}


def test_stratified_counts(spark):
    df = spark.range(1000).select("id", F.when(F.col("id") < 700, "a").when(F.col("id") < 990, "b").alias("s"))
    got = splits.random_split(df, "id", stratum="s").groupBy("s", "split").count().collect()
    n = {(r["s"], r["split"]): r["count"] for r in got}
    assert n == {("a", "train"): 560, ("a", "test"): 140, ("b", "train"): 232, ("b", "test"): 58, (None, "train"): 8, (None, "test"): 2}
    text = df.withColumn("id", F.concat(F.lit("r"), "id"))
    assert splits.random_split(text, "id").where("split = 'train'").count() == 800


def test_entities_stay_together(spark):
    df = spark.range(500).select("id", (F.col("id") % 50).alias("e"))
    got = splits.entity_split(df, "e").groupBy("e").agg(F.countDistinct("split").alias("n")).collect()
    assert {r["n"] for r in got} == {1}


def test_scores(spark):
    rows = [("a", "a"), ("a", "b"), ("b", "b"), ("b", "b"), ("c", "a")]
    df = spark.createDataFrame(rows, "y_true string, y_pred string")
    s = metrics.class_scores(df).first()
    f1 = (2 * (2 * 1 / 4) + 2 * (2 * 2 / 5) + 1 * 0) / 5
    assert (s["n"], s["accuracy"], s["f1_weighted"]) == (5, 0.6, round(f1, 4))
    assert metrics.confusion(df).count() == 9
    flat = spark.createDataFrame([(1.0, 1.0), (1.0, 2.0)], "y_true double, y_pred double")
    assert metrics.regression_scores(flat).first()["r2"] == 0.0
    auc = spark.createDataFrame([(True, 0.9), (False, 0.9), (True, 0.5), (False, 0.1)], "p boolean, s double")
    assert metrics.roc_auc(auc, "p", "s").first()["auc"] == 0.625


def test_regression_forest_is_fitted_on_all_rows(spark, monkeypatch):
    seen = []
    rows = spark.range(400).select("id", (F.col("id") % 7).cast("double").alias("a"), (F.col("id") % 5 * 2.0).alias("z"))
    fit = models.Pipeline.fit
    monkeypatch.setattr(models.Pipeline, "fit", lambda self, df: seen.append(df.count()) or fit(self, df))
    given = inspect.signature(models.run_regression).parameters["fit_rows"].default
    assert given is None
    run = models.run_regression(rows, "z", "id", ["a"], models=[models.FOREST], trees=2, depth=3, importance=False)
    assert seen == [run.summary["n_train"]]


@pytest.mark.parametrize("task,target", [("classification", "y"), ("regression", "z")])
def test_margins_give_what_swapped_rows_give(sample, monkeypatch, task, target):
    run = models.run_classification if task == "classification" else models.run_regression
    name = models.LOGISTIC if task == "classification" else models.RIDGE
    rows = sample.withColumn("flat", F.lit(3.0))
    fast = run(rows, target, "id", ["a", "b", "flat"], models=[name], repeats=3).importance.collect()
    monkeypatch.setattr(models, "_linear_weights", lambda *_: None)
    slow = run(rows, target, "id", ["a", "b", "flat"], models=[name], repeats=3).importance.collect()
    assert {r["feature"]: r["importance"] for r in fast} == pytest.approx({r["feature"]: r["importance"] for r in slow}, abs=1e-9)
    assert len(fast) == 3 and [r["feature"] for r in fast] == [r["feature"] for r in slow]
