"""Exploratory classification and regression on spark.ml.

The input becomes one narrow table (row key, label, features), written once; every fit, score and
importance pass reads that table.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import (
    LogisticRegression,
    LogisticRegressionModel,
    RandomForestClassifier,
)
from pyspark.ml.feature import (
    OneHotEncoder,
    OneHotEncoderModel,
    SQLTransformer,
    StandardScaler,
    StandardScalerModel,
    StringIndexer,
    VectorAssembler,
)
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import LinearRegression, LinearRegressionModel, RandomForestRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from studyspark.functions.coerce import numeric_of
from studyspark.functions.hashing import SPAN, spread
from studyspark.operators.lineage import cut
from studyspark.operators.metrics import class_scores, confusion, regression_scores, roc_auc
from studyspark.operators.order import bucket_depth, hash_bucket, hash_positions, quantiles
from studyspark.operators.ridge import ridge_by_folds
from studyspark.operators.splits import (
    TEST,
    TRAIN,
    entity_split,
    fold_of,
    random_split,
    time_split,
)

MIN_TRAIN, MIN_TEST = 10, 5
STRATIFY_UP_TO, STRATIFY_UP_TO_ROLES = 10, 49
MIN_ROWS = 20
FOREST_ROWS, FOREST_SEED = 200_000, 77
RARE_CLASS, RARE_BELOW = 5, 200
# Guards on what comes to the driver: a target with more classes is a number or an id, not a class,
# and a text feature with more levels is free text or an id (`ridge.ridge_with_levels` takes those).
MOST_CLASSES, MOST_LEVELS = 200, 10_000

LOGISTIC, FOREST, RIDGE = "Logistic Regression", "Random Forest", "Ridge Regression"
# Model choices offered to the user.
MODEL_CHOICES = {
    "Auto": None,
    "Logistic": LOGISTIC,
    "RF Classifier": FOREST,
    "Ridge": RIDGE,
    "RF Regressor": FOREST,
}


@dataclass
class ModelRun:
    """Tidy result tables of one run; `error` is set instead when a guard failed."""

    task: str
    error: str | None = None
    errors: dict[str, str] = field(default_factory=dict)  # by model, where one could not be fitted
    summary: dict = field(default_factory=dict)
    metrics: DataFrame | None = None
    importance: DataFrame | None = None
    confusion: DataFrame | None = None
    predictions: dict[str, DataFrame] = field(default_factory=dict)
    models: dict[str, PipelineModel] = field(default_factory=dict)

    def save(self, folder: str) -> None:
        """Pipelines and result tables under one folder."""
        for name, model in self.models.items():
            model.write().overwrite().save(f"{folder}/{name.lower().replace(' ', '_')}")
        for name in ("metrics", "importance", "confusion"):
            table = getattr(self, name)
            if table is not None:
                table.write.mode("overwrite").parquet(f"{folder}/{name}")


def default_features(
    df: DataFrame, target: str, exclude: Sequence[str | None] = (), limit: int | None = None
) -> list[str]:
    """Numeric columns but the target, the QC flags and `exclude` (keys, ids, times)."""
    out = {target, "qc_keep", "qc_reason", *exclude}
    return [
        f.name for f in df.schema if isinstance(f.dataType, T.NumericType) and f.name not in out
    ][:limit]


def time_features(df: DataFrame, time: str) -> DataFrame:
    """Add year, month, dow (Monday = 0) and hour."""
    t = F.col(time)
    return df.withColumns(
        {"year": F.year(t), "month": F.month(t), "dow": F.weekday(t), "hour": F.hour(t)}
    )


def choose_task(df: DataFrame, outcome: str | None, target: str | None) -> tuple[str, str]:
    """Classification when the outcome column has values, else regression on the target."""
    for task, col in (("classification", outcome), ("regression", target)):
        if col in df.columns and df.where(F.col(col).isNotNull()).limit(1).count():
            return task, col
    raise ValueError("no outcome or target column with values")


def rare_class_warning(class_counts: dict, n: int) -> bool:
    return n < RARE_BELOW and any(c < RARE_CLASS for c in class_counts.values())


def model_table(
    df: DataFrame,
    features: Sequence[str],
    target: str,
    key: str,
    extra: Mapping[str, str] | None = None,
) -> DataFrame:
    """Rows with a target: key, target as `_y`, numeric features coerced, text features kept."""
    cols = []
    for c in features:
        text = isinstance(df.schema[c].dataType, T.StringType)
        cols.append(F.col(c) if text else numeric_of(df, c).alias(c))
    rows = df.where(F.col(target).isNotNull())
    return rows.select(
        F.col(key).alias("_key"),
        F.col(target).alias("_y"),
        *cols,
        *[F.col(c).alias(f"_x_{name}") for name, c in (extra or {}).items()],
    )


def medians(df: DataFrame, cols: Sequence[str], seen: DataFrame | None = None) -> dict[str, float]:
    """Exact medians over `df` of the columns with a gap anywhere in `seen`.

    A column without values imputes 0. Complete columns cost one count, not a quantile.
    """
    if not cols:
        return {}
    seen = df if seen is None else seen
    filled = seen.agg(F.count("*"), *[F.count(c) for c in cols]).first()
    gaps = [c for c, n in zip(cols, filled[1:]) if n < filled[0]]
    if not gaps:
        return {}
    found = {r["feature"]: r["p50"] for r in quantiles(df, gaps, [0.5]).collect()}
    return {c: found.get(c, 0.0) for c in gaps}


def feature_stages(rows: DataFrame, features: Sequence[str], impute: dict[str, float]) -> list:
    """Impute, one-hot (first sorted level dropped, missing text all zero) and assemble.

    Levels come from all rows with a target, train and test, so that no test row is lost to a level
    that training rows don't have.
    """
    text = [c for c in features if isinstance(rows.schema[c].dataType, T.StringType)]
    number = [c for c in features if c not in text]
    filled = [
        f"coalesce(`{c}`, {impute[c]!r}D) AS `_f_{c}`" if c in impute else f"`{c}` AS `_f_{c}`"
        for c in number
    ]
    stages: list = []
    extra = list(filled)
    if text:
        first = rows.agg(*[F.min(c).alias(c) for c in text]).first()
        for c in text:
            level = (first[c] or "").replace("\\", "\\\\").replace("'", "\\'")
            extra.append(f"coalesce(`{c}`, '{level}') AS `_f_{c}`")
    stages.append(SQLTransformer(statement=f"SELECT *, {', '.join(extra)} FROM __THIS__"))
    slots = [f"_f_{c}" for c in number]
    if text:
        # descending order puts the first level last, where the encoder drops it
        indexer = StringIndexer(
            inputCols=[f"_f_{c}" for c in text],
            outputCols=[f"_i_{c}" for c in text],
            stringOrderType="alphabetDesc",
            handleInvalid="error",
        )
        stages.append(indexer.fit(stages[0].transform(rows)))
        stages.append(
            OneHotEncoder(
                inputCols=[f"_i_{c}" for c in text], outputCols=[f"_o_{c}" for c in text]
            )
        )
        slots += [f"_o_{c}" for c in text]
    stages.append(VectorAssembler(inputCols=slots, outputCol="_raw", handleInvalid="keep"))
    return stages


def slot_names(transformed: DataFrame, col: str = "_raw") -> list[str]:
    meta = transformed.schema[col].metadata.get("ml_attr", {}).get("attrs", {})
    slots = sorted((a for group in meta.values() for a in group), key=lambda a: a["idx"])
    return [s["name"].removeprefix("_f_").removeprefix("_o_") for s in slots]


def logistic(n: int, c: float = 1.0, max_iter: int = 500) -> list:
    """Standardised L2 logistic regression with penalty 1/(C n).

    The scaler divides by the sample sd; the factor (n - 1)/n restores the penalty on
    population-scaled features.
    """
    return [
        StandardScaler(inputCol="_raw", outputCol="_vec", withMean=True, withStd=True),
        LogisticRegression(
            featuresCol="_vec",
            labelCol="_label",
            predictionCol="_pred",
            probabilityCol="_prob",
            rawPredictionCol="_margin",
            regParam=(n - 1) / (c * n * n),
            elasticNetParam=0.0,
            standardization=False,
            maxIter=max_iter,
            tol=1e-9,
        ),
    ]


def ridge(n: int, y_sd: float, alpha: float = 1.0) -> list:
    """Standardised ridge by normal equations: one pass over the rows at any size."""
    return [
        StandardScaler(inputCol="_raw", outputCol="_vec", withMean=True, withStd=True),
        LinearRegression(
            featuresCol="_vec",
            labelCol="_label",
            predictionCol="_pred",
            solver="normal",
            regParam=alpha * y_sd * (n - 1) / (n * n) if y_sd else 0.0,
            elasticNetParam=0.0,
            standardization=False,
        ),
    ]


def forest_classifier(trees: int = 100, depth: int = 30, seed: int = 42) -> list:
    return [
        RandomForestClassifier(
            featuresCol="_raw",
            labelCol="_label",
            predictionCol="_pred",
            probabilityCol="_prob",
            rawPredictionCol="_margin",
            numTrees=trees,
            maxDepth=depth,
            minInstancesPerNode=3,
            seed=seed,
        )
    ]


def forest_regressor(trees: int = 100, depth: int = 30, seed: int = 42) -> list:
    return [
        RandomForestRegressor(
            featuresCol="_raw",
            labelCol="_label",
            predictionCol="_pred",
            numTrees=trees,
            maxDepth=depth,
            minInstancesPerNode=3,
            featureSubsetStrategy="all",
            seed=seed,
        )
    ]


def impurity_importance(model: PipelineModel, sample: DataFrame) -> dict[str, float]:
    names = slot_names(model.transform(sample.limit(0)))
    scores = model.stages[-1].featureImportances.toArray()
    return dict(sorted(zip(names, map(float, scores)), key=lambda kv: (-kv[1], kv[0])))


def _linear_weights(model: PipelineModel, features: Sequence[str]) -> list[float] | None:
    """Weight of each numeric feature in the margin (or prediction) of a linear model of two classes
    or a number; None for any other model and with text features."""
    scaler, last = model.stages[-2:]
    two = isinstance(last, LogisticRegressionModel) and last.numClasses == 2
    if not (two or isinstance(last, LinearRegressionModel)) or not isinstance(scaler, StandardScalerModel):
        return None
    if any(isinstance(s, OneHotEncoderModel) for s in model.stages):
        return None
    coefs, sds = last.coefficients.toArray(), scaler.std.toArray()
    return [float(c / s) if s else 0.0 for c, s in zip(coefs, sds, strict=True)]


def _score(pred: Column, task: str) -> Column:
    y = F.col("_label")
    if task == "classification":
        return F.avg((y == pred).cast("double"))
    return 1 - F.try_divide(F.avg((y - pred) * (y - pred)), F.var_pop(y))


def _linear_importance(
    model: PipelineModel, placed: DataFrame, features: Sequence[str], weights: list[float], n: int, shifts: list[int], task: str
) -> DataFrame:
    """Permutation importance without a row per feature: a swapped value moves the margin by its
    weight times the difference, so one row gives the predictions of all features."""
    margin = vector_to_array("_margin")[1] if task == "classification" else F.col("_pred")
    scored = cut(
        model.transform(placed).select("_pos", "_label", margin.alias("_m"), *[F.col(f"_f_{c}").cast("double").alias(f"_v{j}") for j, c in enumerate(features)])
    )

    def predicted(m: Column) -> Column:
        return (m > 0).cast("double") if task == "classification" else m

    base = scored.agg(_score(predicted(F.col("_m")), task)).first()[0]
    runs = F.array(*[F.struct(F.lit(r).alias("_r"), F.lit(s).alias("_shift")) for r, s in enumerate(shifts)])
    rows = scored.select("*", F.inline(runs)).withColumn("_donor", F.pmod(F.col("_pos") + F.col("_shift"), F.lit(n)))
    donors = scored.select(F.col("_pos").alias("_donor"), *[F.col(f"_v{j}").alias(f"_d{j}") for j in range(len(features))])
    moved = [F.col("_m") + F.lit(w) * (F.col(f"_d{j}") - F.col(f"_v{j}")) for j, w in enumerate(weights)]
    per_run = rows.join(donors, "_donor").groupBy("_r").agg(
        *[_score(predicted(m), task).alias(f"_s{j}") for j, m in enumerate(moved)]
    )
    pairs = [F.struct(F.lit(c).alias("feature"), F.col(f"_s{j}").alias("_s")) for j, c in enumerate(features)]
    return (
        per_run.select(F.inline(F.array(*pairs)))
        .groupBy("feature")
        .agg((F.lit(base) - F.avg("_s")).alias("importance"))
        .orderBy(F.desc("importance"), "feature")
    )


def permutation_importance(
    model: PipelineModel,
    test: DataFrame,
    features: Sequence[str],
    n: int,
    task: str,
    repeats: int = 5,
    seed: int = 42,
) -> DataFrame:
    """(feature, importance): mean drop of accuracy or R2 when one feature is shuffled.

    Rows stand in hash order; in repeat r a row takes the value of the row a fixed, hashed number of
    places on. One equi-join on the position serves all features and repeats.
    """
    h = spread(F.col("_key"), test.schema["_key"].dataType, seed)
    placed = cut(
        hash_positions(
            test.select("_key", "_label", *features).withColumn("_h", h),
            [F.col("_h"), F.col("_key")],
            hash_bucket(F.col("_h"), bucket_depth(test)),
        ).drop("_h")
    )
    shifts = [1 + (seed * 7919 + r * 104729) % max(n - 1, 1) for r in range(repeats)]
    weights = _linear_weights(model, features)
    if weights is not None:
        return _linear_importance(model, placed, features, weights, n, shifts, task)
    runs = F.array(
        *[F.struct(F.lit(r).alias("_r"), F.lit(s).alias("_shift")) for r, s in enumerate(shifts)]
    )
    rows = placed.select("*", F.inline(runs)).withColumn(
        "_donor", F.pmod(F.col("_pos") + F.col("_shift"), F.lit(n))
    )
    donors = placed.select(
        F.col("_pos").alias("_dpos"), *[F.col(c).alias(f"_d_{c}") for c in features]
    )
    both = rows.join(donors, F.col("_donor") == F.col("_dpos")).withColumn(
        "_j", F.explode(F.sequence(F.lit(0), F.lit(len(features) - 1)))
    )
    swapped = both.select(
        "_r",
        "_j",
        "_label",
        *[
            F.when(F.col("_j") == i, F.col(f"_d_{c}")).otherwise(F.col(c)).alias(c)
            for i, c in enumerate(features)
        ],
    )

    def score(pred: DataFrame, *by: str) -> DataFrame:
        y, p = F.col("_label"), F.col("_pred")
        if task == "classification":
            s = F.avg((y == p).cast("double"))
        else:
            s = 1 - F.try_divide(F.avg((y - p) * (y - p)), F.var_pop(y))
        return pred.groupBy(*by).agg(s.alias("_s")) if by else pred.agg(s.alias("_s"))

    base = score(model.transform(placed)).first()["_s"]
    name = F.element_at(F.array(*[F.lit(c) for c in features]), F.col("_j") + 1)
    return (
        score(model.transform(swapped), "_r", "_j")
        .groupBy(name.alias("feature"))
        .agg((F.lit(base) - F.avg("_s")).alias("importance"))
        .orderBy(F.desc("importance"), "feature")
    )


def _split(
    rows: DataFrame,
    split: str,
    test_share: float,
    seed: int,
    classes: int | None,
    strata_limit: int,
    fold: tuple[int, int] | None = None,
):
    if fold is not None:
        here = fold_of(rows, "_x_entity", fold[1], seed) == fold[0]
        return rows.withColumn("split", F.when(here, F.lit(TEST)).otherwise(F.lit(TRAIN)))
    if split == "time":
        return time_split(rows, "_x_time", "_key", test_share)
    if split == "entity":
        folds = max(round(1 / test_share), 2)
        return entity_split(rows, "_x_entity", 1, folds, seed)
    strata = "_label" if classes is not None and classes <= strata_limit else None
    return random_split(rows, "_key", test_share, seed, strata)


def _fit_all(
    run: ModelRun,
    rows: DataFrame,
    features: list[str],
    recipes: dict[str, list],
    impute: dict[str, float],
    label_value: Column,
    importance: bool,
    repeats: int,
    fit_rows: int | None,
) -> None:
    """Fit and score each recipe; one that fails leaves its message in `run.errors`.

    Forests are fitted on at most about `fit_rows` training rows, chosen by the hash of the key, as
    their nodes grow with the rows; None takes all. Every other model reads all training rows.
    """
    train = rows.where(F.col("split") == TRAIN)
    test = rows.where(F.col("split") == TEST)
    binary = run.summary.get("n_classes") == 2
    scores, importances, cells = [], [], []
    encode = feature_stages(rows, features, impute)
    for name, stages in recipes.items():
        fit_on = train
        if name == FOREST and fit_rows is not None and run.summary["n_train"] > fit_rows:
            h = spread(F.col("_key"), train.schema["_key"].dataType, FOREST_SEED)
            fit_on = train.where(h < int(SPAN * fit_rows / run.summary["n_train"]))
        try:
            model = Pipeline(stages=[*encode, *stages]).fit(fit_on)
        except Exception as failure:  # noqa: BLE001 - any solver's failure concerns this model only
            run.errors[name] = str(failure).splitlines()[0]
            continue
        run.models[name] = model
        out = [F.col("_key").alias("row_key"), F.col("_label"), F.col("_pred")]
        if binary:
            out.append(F.round(vector_to_array("_prob")[1], 10).alias("p_class1"))
        pred = cut(model.transform(test).select(*out))
        shown = pred.select(
            "row_key",
            label_value_of(label_value, "_label").alias("y_true"),
            label_value_of(label_value, "_pred").alias("y_pred"),
            *(["p_class1"] if binary else []),
        )
        run.predictions[name] = shown
        if run.task == "classification":
            parts = [class_scores(pred, "_label", "_pred").select("accuracy", "f1_weighted")]
            if binary:
                auc = roc_auc(pred.withColumn("_p", F.col("_label") == 1), "_p", "p_class1")
                parts.append(auc.select("auc"))
            cells.append(confusion(shown).withColumn("model", F.lit(name)))
        else:
            parts = [regression_scores(pred, "_label", "_pred").drop("n")]
        for part in parts:
            scores += [(name, m, v) for m, v in part.first().asDict().items() if v is not None]
        if importance:
            if name == FOREST:
                got = impurity_importance(model, train)
            else:
                got = {
                    r["feature"]: r["importance"]
                    for r in permutation_importance(
                        model, test, features, run.summary["n_test"], run.task, repeats
                    ).collect()
                }
            importances += [(name, i + 1, f, v) for i, (f, v) in enumerate(got.items())]
    spark = rows.sparkSession
    run.metrics = spark.createDataFrame(scores, "model string, metric string, value double")
    run.importance = spark.createDataFrame(
        importances, "model string, ord int, feature string, importance double"
    )
    if cells:
        run.confusion = cells[0]
        for c in cells[1:]:
            run.confusion = run.confusion.unionByName(c)
    if run.task == "classification":
        f1 = {m: v for m, metric, v in scores if metric == "f1_weighted"}
        run.summary["best_model"] = max(f1, key=f1.get) if f1 else None


def label_value_of(table: Column | None, col: str) -> Column:
    if table is None:
        return F.col(col)
    return F.element_at(table, F.col(col).cast("int") + 1)


def _usable_features(run: ModelRun, raw: DataFrame, features: list[str]) -> list[str]:
    """Features but text of more than MOST_LEVELS levels; those are named in `run.errors`."""
    text = [c for c in features if isinstance(raw.schema[c].dataType, T.StringType)]
    if not text:
        return features
    # a sketch finds the candidates, and only they are counted exactly, up to the bound
    sketch = raw.agg(*[F.approx_count_distinct(c).alias(c) for c in text]).first()
    wide = [c for c in text if sketch[c] > MOST_LEVELS // 2]
    wide = [c for c in wide if raw.select(c).distinct().limit(MOST_LEVELS + 1).count() > MOST_LEVELS]
    for c in wide:
        run.errors[c] = f"More than {MOST_LEVELS} levels: left out as free text or an id."
    return [c for c in features if c not in wide]


def _prepare(df, features, target, key, time_col, entity) -> DataFrame:
    extra = {"time": time_col, "entity": None if time_col else entity}
    return model_table(df, features, target, key, {n: c for n, c in extra.items() if c})


def run_classification(
    df: DataFrame,
    target: str,
    key: str,
    features: Sequence[str] | None = None,
    time_col: str | None = None,
    entity: str | None = None,
    test_share: float = 0.2,
    seed: int = 42,
    models: Sequence[str] = (LOGISTIC, FOREST),
    impute_scope: str = "train",
    importance: bool = True,
    repeats: int = 5,
    trees: int = 100,
    depth: int = 30,
    fit_rows: int | None = FOREST_ROWS,
    exclude: Sequence[str] = (),
    stratify_up_to: int = STRATIFY_UP_TO,
    fold: tuple[int, int] | None = None,
) -> ModelRun:
    """Logistic regression and a random forest; time order, entities or strata decide the split."""
    features = list(
        features or default_features(df, target, [key, entity, time_col, *exclude])
    )
    split = "time" if time_col else "entity" if entity else "random"
    raw = _prepare(df, features, target, key, time_col, entity)
    counts = raw.groupBy("_y").agg(F.count("*").alias("n")).limit(MOST_CLASSES + 1).collect()
    run = ModelRun("classification")
    if len(counts) < 2:
        run.error = "The target needs at least two classes."
        return run
    if len(counts) > MOST_CLASSES:
        run.error = f"The target has more than {MOST_CLASSES} classes; model it as a number or group it."
        return run
    features = _usable_features(run, raw, features)
    if not features:
        run.error = "No feature is left to model from."
        return run
    class_counts = {r["_y"]: r["n"] for r in counts}
    classes = sorted(class_counts)
    label = F.when(F.lit(False), F.lit(0.0))
    for i, c in enumerate(classes):
        label = label.when(F.col("_y") == F.lit(c), F.lit(float(i)))
    rows = cut(
        _split(
            raw.withColumn("_label", label),
            split,
            test_share,
            seed,
            len(classes),
            stratify_up_to,
            fold,
        )
    )
    n = {r["split"]: r["n"] for r in rows.groupBy("split").agg(F.count("*").alias("n")).collect()}
    if n.get(TRAIN, 0) < MIN_TRAIN or n.get(TEST, 0) < MIN_TEST:
        run.error = f"One part of the split is too small (train {n.get(TRAIN, 0)}, test {n.get(TEST, 0)})."
        return run
    run.summary = {
        "task": "classification",
        "split_type": {"time": "time-based", "entity": "entity-disjoint"}.get(split, split),
        "n_train": n[TRAIN],
        "n_test": n[TEST],
        "n_classes": len(classes),
        "classes": classes,
        "features": features,
        "rare_classes": rare_class_warning(class_counts, sum(class_counts.values())),
    }
    train = rows.where(F.col("split") == TRAIN)
    number = [c for c in features if not isinstance(rows.schema[c].dataType, T.StringType)]
    impute = medians(train if impute_scope == "train" else rows, number, rows)
    recipes = {LOGISTIC: logistic(n[TRAIN]), FOREST: forest_classifier(trees, depth, seed)}
    names = F.array(*[F.lit(c) for c in classes])
    chosen = {m: recipes[m] for m in models}
    _fit_all(run, rows, features, chosen, impute, names, importance, repeats, fit_rows)
    return run


def run_regression(
    df: DataFrame,
    target: str,
    key: str,
    features: Sequence[str] | None = None,
    time_col: str | None = None,
    entity: str | None = None,
    test_share: float = 0.2,
    seed: int = 42,
    models: Sequence[str] = (RIDGE, FOREST),
    impute_scope: str = "train",
    importance: bool = True,
    repeats: int = 5,
    trees: int = 100,
    depth: int = 30,
    fit_rows: int | None = None,
    exclude: Sequence[str] = (),
    fold: tuple[int, int] | None = None,
) -> ModelRun:
    """Ridge regression and a random forest, fitted on all training rows unless `fit_rows` bounds
    those of the forest."""
    features = list(
        features or default_features(df, target, [key, entity, time_col, *exclude])
    )
    split = "time" if time_col else "entity" if entity else "random"
    raw = _prepare(df, features, target, key, time_col, entity)
    raw = raw.withColumn("_label", numeric_of(raw, "_y")).where("_label is not null")
    run = ModelRun("regression")
    features = _usable_features(run, raw, features)
    if not features:
        run.error = "No feature is left to model from."
        return run
    rows = cut(_split(raw, split, test_share, seed, None, 0, fold))
    got = rows.groupBy("split").agg(F.count("*").alias("n"), F.sum("_label").alias("s")).collect()
    n = {r["split"]: r["n"] for r in got}
    if n.get(TRAIN, 0) < MIN_TRAIN or n.get(TEST, 0) < MIN_TEST:
        run.error = f"One part of the split is too small (train {n.get(TRAIN, 0)}, test {n.get(TEST, 0)})."
        return run
    run.summary = {
        "task": "regression",
        "split_type": {"time": "time-based", "entity": "entity-disjoint"}.get(split, split),
        "n_train": n[TRAIN],
        "n_test": n[TEST],
        "target_mean": round(sum(r["s"] for r in got) / sum(n.values()), 4),
        "features": features,
    }
    train = rows.where(F.col("split") == TRAIN)
    number = [c for c in features if not isinstance(rows.schema[c].dataType, T.StringType)]
    impute = medians(train if impute_scope == "train" else rows, number, rows)
    y_sd = train.agg(F.stddev_pop("_label")).first()[0]
    recipes = {RIDGE: ridge(n[TRAIN], y_sd), FOREST: forest_regressor(trees, depth, seed)}
    chosen = {m: recipes[m] for m in models}
    _fit_all(run, rows, features, chosen, impute, None, importance, repeats, fit_rows)
    return run


def _ridge_folds(df, target, key, entity, folds, features, seed) -> DataFrame | None:
    """All folds from sums of one pass; None with text features or gaps, whose coding differs by fold."""
    features = list(features or default_features(df, target, [key, entity]))
    raw = _prepare(df, features, target, key, None, entity)
    if any(isinstance(raw.schema[c].dataType, T.StringType) for c in features):
        return None
    raw = raw.withColumn("_label", numeric_of(raw, "_y")).where("_label is not null")
    rows = cut(raw.select(fold_of(raw, "_x_entity", folds, seed).alias("_fold"), "_label", *features))
    got = ridge_by_folds(rows, features, folds, 1.0, MIN_TRAIN, MIN_TEST)
    if got is None:
        return None
    names = ("mae", "rmse", "r2")
    listed = [(f, RIDGE, m, v) for f, *scores in got for m, v in zip(names, scores) if v is not None]
    return df.sparkSession.createDataFrame(listed, "fold int, model string, metric string, value double")


def cross_validate(
    df: DataFrame, task: str, target: str, key: str, entity: str, folds: int = 5, **options
) -> DataFrame:
    """(fold, model, metric, value): each fold of entities is the test part once.

    No entity is in both parts of a fold. Ridge alone on complete numbers takes sums of one pass for
    all folds. A fold that a guard rejects, or a model that fails in it,
    has no rows. Options are those of `run_classification` or `run_regression`.
    """
    run = run_regression if task == "regression" else run_classification
    options.setdefault("importance", False)
    out = []
    if task == "regression" and options.get("models") == [RIDGE] and not options["importance"]:
        once = _ridge_folds(df, target, key, entity, folds, options.get("features"), options.get("seed", 42))
        if once is not None:
            return once
    for f in range(folds):
        got = run(df, target, key, entity=entity, fold=(f, folds), **options)
        if got.error is None:
            out += [(f, r["model"], r["metric"], r["value"]) for r in got.metrics.collect()]
    return df.sparkSession.createDataFrame(out, "fold int, model string, metric string, value double")


def run_by_roles(
    df: DataFrame,
    key: str,
    outcome: str | None = None,
    target: str | None = None,
    id_col: str | None = None,
    time_col: str | None = None,
    model: str = "Auto",
    **options,
) -> ModelRun:
    """Model the mapped outcome (classes) or target (number) from all other columns.

    Flagged rows are left out. A parsed time column gives year, month, weekday and hour; ids, times
    and flags are not features.
    """
    kept = df.where(F.col("qc_keep").cast("boolean")) if "qc_keep" in df.columns else df
    task, y = choose_task(kept, outcome, target)
    if kept.where(F.col(y).isNotNull()).limit(MIN_ROWS).count() < MIN_ROWS:
        return ModelRun(task, error=f"Not enough rows to train a model (need {MIN_ROWS}).")
    if time_col:
        kept = time_features(kept, time_col)
    out = {"qc_reason", "qc_keep", key, id_col, time_col, y}
    usable = (T.NumericType, T.BooleanType, T.StringType)
    features = [f.name for f in kept.schema if f.name not in out and isinstance(f.dataType, usable)]
    picked = MODEL_CHOICES[model]
    if task == "classification":
        models = [picked] if picked in (LOGISTIC, FOREST) else [LOGISTIC, FOREST]
        options.setdefault("stratify_up_to", STRATIFY_UP_TO_ROLES)
        return run_classification(kept, y, key, features, models=models, **options)
    models = [picked] if picked in (RIDGE, FOREST) else [RIDGE, FOREST]
    return run_regression(kept, y, key, features, models=models, **options)
