"""Splits, scores and exploratory models."""

from __future__ import annotations

import uuid

from pyspark.ml import PipelineModel
from pyspark.sql import functions as F

from studyspark.catalog.base import REGISTRY, query, table
from studyspark.operators import metrics, models, ridge, splits, trees
from studyspark.operators.lineage import shared_folder

# the split hash of a key that isn't negative, in plain arithmetic
HASH = (
    "((CAST(({key} + 42) % 4294967296 + (({key} + 42) // 4294967296 * 2246822519) % 4294967296 AS HUGEINT)"
    " % 4294967296) * 2654435761) % 4294967296"
)


@query(
    """SELECT o_orderkey, CASE WHEN row_number() OVER (ORDER BY o_orderdate, o_orderkey)
  <= CAST(floor((SELECT count(*) FROM orders) * 0.8) AS BIGINT) THEN 'train' ELSE 'test' END AS split
FROM orders"""
)
def split_by_time(spark, folder):
    out = splits.time_split(table(spark, folder, "orders"), "o_orderdate", "o_orderkey")
    return out.select("o_orderkey", "split")


@query(
    """WITH v AS (SELECT event_id, CASE WHEN event_type = 'signup' THEN NULL ELSE user_id END AS t FROM events)
SELECT event_id, CASE WHEN row_number() OVER (ORDER BY t NULLS LAST, event_id)
  <= CAST(floor((SELECT count(*) FROM v) * 0.9) AS BIGINT) THEN 'train' ELSE 'test' END AS split FROM v"""
)
def split_by_time_missing(spark, folder):
    """Many equal and missing times: the cut falls among the missing ones, by row key."""
    e = table(spark, folder, "events").withColumn(
        "t", F.when(F.col("event_type") != "signup", F.col("user_id"))
    )
    return splits.time_split(e, "t", "event_id", 0.1).select("event_id", "split")


@query(
    f"""WITH h AS (SELECT o_orderkey, o_orderstatus, {HASH.format(key='o_orderkey')} AS h FROM orders)
SELECT o_orderkey, o_orderstatus, CASE WHEN row_number() OVER (PARTITION BY o_orderstatus
  ORDER BY h, o_orderkey) <= floor(count(*) OVER (PARTITION BY o_orderstatus) * 0.8)
  THEN 'train' ELSE 'test' END AS split FROM h"""
)
def split_stratified(spark, folder):
    o = table(spark, folder, "orders")
    out = splits.random_split(o, "o_orderkey", stratum="o_orderstatus")
    return out.select("o_orderkey", "o_orderstatus", "split")


@query(
    f"""WITH h AS (SELECT event_id, {HASH.format(key='event_id')} AS h FROM events)
SELECT event_id, CASE WHEN row_number() OVER (ORDER BY h, event_id)
  <= floor((SELECT count(*) FROM h) * 0.8) THEN 'train' ELSE 'test' END AS split FROM h"""
)
def split_random(spark, folder):
    out = splits.random_split(table(spark, folder, "events"), "event_id")
    return out.select("event_id", "split")


@query(
    f"""SELECT event_id, user_id, CASE WHEN ({HASH.format(key='user_id')}) * 5 // 4294967296 < 1 THEN 'test'
  ELSE 'train' END AS split FROM events"""
)
def split_by_entity(spark, folder):
    out = splits.entity_split(table(spark, folder, "events"), "user_id")
    return out.select("event_id", "user_id", "split")


@query(
    f"""SELECT event_id, user_id,
  CAST(({HASH.format(key='(user_id * 8589934592 + user_id)')}) * 4 // 4294967296 AS INT) AS fold FROM events"""
)
def folds_of_wide_ids(spark, folder):
    """Four folds over ids above 2^32, as row ids of many partitions are."""
    e = table(spark, folder, "events").withColumn("wide", F.col("user_id") * 8589934592 + F.col("user_id"))
    return e.select("event_id", "user_id", splits.fold_of(e, "wide", 4).alias("fold"))


SCORED = """WITH p AS (SELECT doc_id, quality AS y_true, CAST(n_chars >= 500 AS INT) AS y_pred,
  n_chars AS score FROM labels JOIN documents USING (doc_id))"""


def scored(spark, folder):
    """Labelled documents with a fixed score."""
    return (
        table(spark, folder, "labels")
        .join(table(spark, folder, "documents"), "doc_id")
        .select(
            "doc_id",
            F.col("quality").alias("y_true"),
            (F.col("n_chars") >= 500).cast("int").alias("y_pred"),
            F.col("n_chars").alias("score"),
            (F.col("quality") == 1).alias("good"),
        )
    )


@query(
    SCORED
    + """, l AS (SELECT y, (SELECT count(*) FROM p WHERE y_true = y) AS s,
  (SELECT count(*) FROM p WHERE y_pred = y) AS q,
  (SELECT count(*) FROM p WHERE y_pred = y AND y_true = y) AS tp FROM (VALUES (0), (1)) v(y))
SELECT CAST(sum(s) AS BIGINT) AS n, round(sum(tp) / sum(s), 4) AS accuracy,
  round(sum(s * coalesce(2.0 * tp / nullif(s + q, 0), 0)) / sum(s), 4) AS f1_weighted FROM l"""
)
def cls_metrics(spark, folder):
    return metrics.class_scores(scored(spark, folder))


@query(
    SCORED
    + """ SELECT a.y AS actual, b.y AS predicted,
  (SELECT count(*) FROM p WHERE y_true = a.y AND y_pred = b.y) AS n
FROM (VALUES (0), (1)) a(y), (VALUES (0), (1)) b(y)"""
)
def confusion(spark, folder):
    return metrics.confusion(scored(spark, folder))


@query(
    SCORED
    + """, r AS (SELECT y_true, rank() OVER (ORDER BY score)
    + (count(*) OVER (PARTITION BY score) - 1) / 2.0 AS rk FROM p)
SELECT count(*) FILTER (y_true = 1) AS n_positive, count(*) FILTER (y_true = 0) AS n_negative,
  round((sum(rk) FILTER (y_true = 1) - count(*) FILTER (y_true = 1)
    * (count(*) FILTER (y_true = 1) + 1) / 2.0)
    / (count(*) FILTER (y_true = 1) * count(*) FILTER (y_true = 0)), 4) AS auc FROM r"""
)
def auc(spark, folder):
    return metrics.roc_auc(scored(spark, folder), "good", "score")


@query(
    """SELECT count(*) AS n, round(avg(abs(e)), 4) AS mae, round(sqrt(avg(e * e)), 4) AS rmse,
  round(1 - avg(e * e) / var_pop(l_extendedprice), 4) AS r2
FROM (SELECT l_extendedprice, l_extendedprice - l_quantity * 2000 AS e FROM lineitem)"""
)
def reg_metrics(spark, folder):
    line = table(spark, folder, "lineitem").select(
        F.col("l_extendedprice").alias("y_true"), (F.col("l_quantity") * 2000).alias("y_pred")
    )
    return metrics.regression_scores(line)


@query(
    SCORED
    + """, c AS (SELECT list_distinct([quantile_cont(score, 0.1), quantile_cont(score, 0.2),
  quantile_cont(score, 0.3), quantile_cont(score, 0.4), quantile_cont(score, 0.5),
  quantile_cont(score, 0.6), quantile_cont(score, 0.7), quantile_cont(score, 0.8),
  quantile_cont(score, 0.9)]) AS cuts FROM p)
SELECT CAST(len([x for x in cuts if x <= score]) AS INT) AS bin, count(*) AS n,
  round(avg(score), 4) AS mean_score, round(avg(y_true), 4) AS observed FROM p, c GROUP BY 1"""
)
def calibration(spark, folder):
    return metrics.calibration(scored(spark, folder), "good", "score")


@query(
    """SELECT event_id, CAST(year(ts) AS INT) AS year, CAST(month(ts) AS INT) AS month,
  CAST(isodow(ts) - 1 AS INT) AS dow, CAST(hour(ts) AS INT) AS hour FROM events"""
)
def time_features(spark, folder):
    e = models.time_features(table(spark, folder, "events"), "ts")
    return e.select("event_id", "year", "month", "dow", "hour")


RIDGE = f"""WITH h AS (SELECT event_id, value AS y, CAST(user_id AS DOUBLE) AS a,
    CAST(hour(ts) AS DOUBLE) AS b, {HASH.format(key='event_id')} AS h FROM events),
s AS (SELECT *, row_number() OVER (ORDER BY h, event_id)
  <= floor((SELECT count(*) FROM h) * 0.8) AS train FROM h),
m AS (SELECT count(*) AS n, avg(a) AS ma, stddev_pop(a) AS sa, avg(b) AS mb, stddev_pop(b) AS sb,
  avg(y) AS my FROM s WHERE train),
g AS (SELECT sum((a - ma) / sa * (a - ma) / sa) + 1 AS aa, sum((b - mb) / sb * (b - mb) / sb) + 1 AS bb,
  sum((a - ma) / sa * (b - mb) / sb) AS ab, sum((a - ma) / sa * (y - my)) AS ay,
  sum((b - mb) / sb * (y - my)) AS byy FROM s, m WHERE train),
w AS (SELECT (bb * ay - ab * byy) / (aa * bb - ab * ab) AS wa,
  (aa * byy - ab * ay) / (aa * bb - ab * ab) AS wb FROM g),
p AS (SELECT event_id, y, my + wa * (a - ma) / sa + wb * (b - mb) / sb AS yp FROM s, m, w
  WHERE NOT train)"""


def ridge_run(spark, folder):
    e = models.time_features(table(spark, folder, "events"), "ts")
    return models.run_regression(
        e, "value", "event_id", ["user_id", "hour"], models=[models.RIDGE], importance=False
    )


@query(
    RIDGE
    + """, x AS (SELECT avg(abs(y - yp)) AS mae, sqrt(avg((y - yp) * (y - yp))) AS rmse,
  1 - avg((y - yp) * (y - yp)) / var_pop(y) AS r2 FROM p)
SELECT 'Ridge Regression' AS model, 'mae' AS metric, round(mae, 4) AS value FROM x
UNION ALL SELECT 'Ridge Regression', 'rmse', round(rmse, 4) FROM x
UNION ALL SELECT 'Ridge Regression', 'r2', round(r2, 4) FROM x"""
)
def ridge_fit(spark, folder):
    return ridge_run(spark, folder).metrics


@query(RIDGE + " SELECT event_id AS row_key, y AS y_true, round(yp, 4) AS y_pred FROM p")
def ridge_predictions(spark, folder):
    pred = ridge_run(spark, folder).predictions[models.RIDGE]
    return pred.withColumn("y_pred", F.round("y_pred", 4))


@query(
    f"""WITH h AS (SELECT event_id, value AS y, CAST(user_id AS DOUBLE) AS a, CAST(hour(ts) AS DOUBLE) AS b,
  CAST(({HASH.format(key='user_id')}) * 3 // 4294967296 AS INT) AS part FROM events),
s AS (SELECT h.*, fold, part <> fold AS train FROM h, (VALUES (0), (1), (2)) AS k(fold)),
m AS (SELECT fold, count(*) AS n, avg(a) AS ma, stddev_pop(a) AS sa, avg(b) AS mb, stddev_pop(b) AS sb,
  avg(y) AS my FROM s WHERE train GROUP BY fold),
g AS (SELECT fold, sum((a - ma) / sa * (a - ma) / sa) + 1 AS aa,
  sum((b - mb) / sb * (b - mb) / sb) + 1 AS bb, sum((a - ma) / sa * (b - mb) / sb) AS ab,
  sum((a - ma) / sa * (y - my)) AS ay, sum((b - mb) / sb * (y - my)) AS byy
  FROM s JOIN m USING (fold) WHERE train GROUP BY fold),
w AS (SELECT fold, (bb * ay - ab * byy) / (aa * bb - ab * ab) AS wa,
  (aa * byy - ab * ay) / (aa * bb - ab * ab) AS wb FROM g),
p AS (SELECT fold, y, my + wa * (a - ma) / sa + wb * (b - mb) / sb AS yp
  FROM s JOIN m USING (fold) JOIN w USING (fold) WHERE NOT train),
x AS (SELECT fold, avg(abs(y - yp)) AS mae, sqrt(avg((y - yp) * (y - yp))) AS rmse,
  1 - avg((y - yp) * (y - yp)) / var_pop(y) AS r2 FROM p GROUP BY fold)
SELECT CAST(fold AS INT) AS fold, 'Ridge Regression' AS model, 'mae' AS metric, round(mae, 4) AS value FROM x
UNION ALL SELECT fold, 'Ridge Regression', 'rmse', round(rmse, 4) FROM x
UNION ALL SELECT fold, 'Ridge Regression', 'r2', round(r2, 4) FROM x"""
)
def ridge_folds(spark, folder):
    """Scores of each of three folds that no user is split between."""
    e = models.time_features(table(spark, folder, "events"), "ts")
    return models.cross_validate(
        e, "regression", "value", "event_id", "user_id", 3,
        features=["user_id", "hour"], models=[models.RIDGE],
    )


def labelled(spark, folder):
    d = table(spark, folder, "documents").select(
        "doc_id",
        "lang",
        "n_chars",
        F.size(F.split("text", r"\s+")).alias("n_words"),
        F.size(F.split("text", r"\n")).alias("n_lines"),
    )
    return table(spark, folder, "labels").join(d, "doc_id")


FEATURES = ["n_chars", "n_words", "n_lines", "lang"]

# labelled rows with their split: strata by label, ordered by hash
LABELLED = f"""WITH d AS (
  SELECT l.doc_id, l.quality, l.toxic, d.lang, d.n_chars,
    CAST(len(regexp_split_to_array(d.text, '\\s+')) AS BIGINT) AS n_words,
    CAST(len(string_split(d.text, chr(10))) AS BIGINT) AS n_lines, {HASH.format(key='l.doc_id')} AS h
  FROM labels l JOIN documents d ON l.doc_id = d.doc_id),
s AS (SELECT *, row_number() OVER (PARTITION BY quality ORDER BY h, doc_id)
  <= floor(count(*) OVER (PARTITION BY quality) * 0.8) AS train FROM d)"""


def newton_sql(x: str, y: str, steps: int = 12) -> str:
    """CTEs that fit the standardised two-feature logistic regression on `s WHERE train`.

    Columns {x} and {y} and label quality; the last CTE, w, holds b0, b1, b2 for standardised
    columns. Every step solves the 3 x 3 Newton system by Cramer's rule.
    """
    out = f""",
z AS (SELECT avg({x}) AS mx, stddev_samp({x}) AS sx, avg({y}) AS my, stddev_samp({y}) AS sy,
  CAST(count(*) AS DOUBLE) AS n FROM s WHERE train),
t AS (SELECT s.*, ({x} - mx) / sx AS u, ({y} - my) / sy AS v, (n - 1) / (n * n) AS pen, n FROM s, z),
w0 AS (SELECT 0.0 AS b0, 0.0 AS b1, 0.0 AS b2)"""
    for k in range(1, steps + 1):
        out += f""",
p{k} AS (SELECT u, v, quality - 1 / (1 + exp(-(b0 + b1 * u + b2 * v))) AS e,
  1 / (1 + exp(-(b0 + b1 * u + b2 * v))) * (1 - 1 / (1 + exp(-(b0 + b1 * u + b2 * v)))) AS q,
  b0, b1, b2, pen, n FROM t, w{k - 1} WHERE train),
m{k} AS (SELECT sum(q) AS a, sum(q * u) AS b, sum(q * v) AS c, sum(q * u * u) + any_value(n * pen) AS d,
  sum(q * u * v) AS f, sum(q * v * v) + any_value(n * pen) AS g, sum(e) AS r0,
  sum(e * u) - any_value(n * pen * b1) AS r1, sum(e * v) - any_value(n * pen * b2) AS r2,
  any_value(b0) AS b0, any_value(b1) AS b1, any_value(b2) AS b2 FROM p{k}),
w{k} AS (SELECT
  b0 + (r0 * (d * g - f * f) - b * (r1 * g - f * r2) + c * (r1 * f - d * r2)) / det AS b0,
  b1 + (a * (r1 * g - f * r2) - r0 * (b * g - f * c) + c * (b * r2 - r1 * c)) / det AS b1,
  b2 + (a * (d * r2 - r1 * f) - b * (b * r2 - r1 * c) + r0 * (b * f - d * c)) / det AS b2
  FROM (SELECT *, a * (d * g - f * f) - b * (b * g - f * c) + c * (b * f - d * c) AS det FROM m{k}))"""
    return out + f""",
y AS (SELECT doc_id, h, quality, u, v, 1 / (1 + exp(-(b0 + b1 * u + b2 * v))) AS p
  FROM t, w{steps} WHERE NOT train)"""


TWO_FEATURES = ["n_words", "n_lines"]
NEWTON = LABELLED + newton_sql("n_words", "n_lines")


def facts(spark, run, *more):
    """Sizes and checks of a run as (model, fact, value) rows."""
    rows = []
    for name, pred in run.predictions.items():
        rows += [
            (name, "n_train", float(run.summary["n_train"])),
            (name, "n_test", float(run.summary["n_test"])),
            (name, "n_scored", float(pred.where("y_pred is not null").count())),
        ]
    return spark.createDataFrame([*rows, *more], "model string, fact string, value double")


SIZES = """ SELECT model, fact, value FROM
  (VALUES {models}) AS names(model),
  (SELECT 'n_train' AS fact, CAST(count(*) FILTER (train) AS DOUBLE) AS value FROM s
   UNION ALL SELECT 'n_test', CAST(count(*) FILTER (NOT train) AS DOUBLE) FROM s
   UNION ALL SELECT 'n_scored', CAST(count(*) FILTER (NOT train) AS DOUBLE) FROM s)"""


@query(
    LABELLED
    + SIZES.format(models="('Logistic Regression'), ('Random Forest')")
    + """ UNION ALL SELECT m.model, 'confusion_total', CAST(count(*) FILTER (NOT train) AS DOUBLE)
  FROM s, (VALUES ('Logistic Regression'), ('Random Forest')) m(model) GROUP BY 1
UNION ALL SELECT model, 'accuracy_agrees', 1.0
  FROM (VALUES ('Logistic Regression'), ('Random Forest')) m(model)"""
)
def classify(spark, folder):
    """Logistic regression and forest on a stratified split: every test row is scored once, and the
    reported accuracy is that of the confusion table."""
    run = models.run_classification(
        labelled(spark, folder), "quality", "doc_id", FEATURES, importance=False, trees=20, depth=8
    )
    told = {r["model"]: r["value"] for r in run.metrics.where("metric = 'accuracy'").collect()}
    more = []
    for name in run.predictions:
        cells = run.confusion.where(F.col("model") == name)
        right, total = cells.agg(F.sum(F.when(F.col("actual") == F.col("predicted"), F.col("n"))), F.sum("n")).first()
        more.append((name, "confusion_total", float(total)))
        more.append((name, "accuracy_agrees", float(abs(right / total - told[name]) < 5e-5)))
    return facts(spark, run, *more)


@query(
    NEWTON
    + """ SELECT doc_id AS row_key, quality AS y_true, CAST(p > 0.5 AS INT) AS y_pred,
  round(p, 3) AS p_class1 FROM y"""
)
def logit_predictions(spark, folder):
    pred = models.run_classification(
        labelled(spark, folder), "quality", "doc_id", TWO_FEATURES, models=[models.LOGISTIC], importance=False
    ).predictions[models.LOGISTIC]
    return pred.withColumn("p_class1", F.round("p_class1", 3))


@query(
    LABELLED.replace("d.lang, d.n_chars", "CASE WHEN l.doc_id % 9 = 0 THEN NULL ELSE d.lang END AS lang, d.n_chars")
    + SIZES.format(models="('Logistic Regression')")
)
def classify_with_gaps(spark, folder):
    """Missing numbers and texts, and a level that few rows have, lose no test row."""
    rows = labelled(spark, folder)
    rows = rows.withColumn("lang", F.when(F.col("doc_id") % 9 != 0, F.col("lang"))).withColumn(
        "n_words", F.when(F.col("doc_id") % 7 != 0, F.col("n_words"))
    )
    rare = F.when(F.col("doc_id") == rows.agg(F.max("doc_id")).first()[0], F.lit("rare"))
    rows = rows.withColumn("lang", F.coalesce(rare, F.col("lang")))
    run = models.run_classification(
        rows, "quality", "doc_id", FEATURES, models=[models.LOGISTIC], importance=False
    )
    return facts(spark, run)


SHIFTS = ", ".join(f"({(42 * 7919 + r * 104729)}, {r})" for r in range(5))


@query(
    NEWTON
    + f""",
o AS (SELECT *, row_number() OVER (ORDER BY h, doc_id) - 1 AS pos, count(*) OVER () AS m FROM y),
r AS (SELECT 1 + base % greatest(m - 1, 1) AS shift, rep FROM (VALUES {SHIFTS}) AS f(base, rep),
  (SELECT max(m) AS m FROM o)),
g AS (SELECT 'n_words' AS feature, rep, avg(CAST((b0 + b1 * k.u + b2 * o.v > 0) = (o.quality = 1) AS INT)) AS a
  FROM o, r, w12, o k WHERE k.pos = (o.pos + shift) % o.m GROUP BY rep
  UNION ALL SELECT 'n_lines', rep, avg(CAST((b0 + b1 * o.u + b2 * k.v > 0) = (o.quality = 1) AS INT))
  FROM o, r, w12, o k WHERE k.pos = (o.pos + shift) % o.m GROUP BY rep),
i AS (SELECT feature, (SELECT avg(CAST((p > 0.5) = (quality = 1) AS INT)) FROM y) - avg(a) AS importance
  FROM g GROUP BY feature)
SELECT 'Logistic Regression' AS model, CAST(row_number() OVER (ORDER BY importance DESC, feature) AS INT) AS ord,
  feature, round(importance, 4) AS importance FROM i
UNION ALL SELECT 'Random Forest', 0, 'all together', 1.0"""
)
def importances(spark, folder):
    """Permutation importance of the logistic model; the forest's impurity shares add up to one."""
    found = models.run_classification(
        labelled(spark, folder), "quality", "doc_id", TWO_FEATURES, trees=20, depth=8
    ).importance
    logit = found.where(F.col("model") == models.LOGISTIC).withColumn("importance", F.round("importance", 4))
    forest = found.where(F.col("model") == models.FOREST).groupBy("model").agg(
        F.lit(0).alias("ord"), F.lit("all together").alias("feature"), F.round(F.sum("importance"), 4).alias("importance")
    )
    return logit.unionByName(forest)


@query(
    f"""WITH d AS (SELECT doc_id, {HASH.format(key='doc_id')} AS h FROM labels JOIN documents USING (doc_id)),
s AS (SELECT row_number() OVER (ORDER BY h, doc_id) <= floor(count(*) OVER () * 0.8) AS train FROM d)"""
    + SIZES.format(models="('Random Forest')")
    + """ UNION ALL SELECT 'Random Forest', 'importance_total', 1.0
UNION ALL SELECT 'Random Forest', 'mae_within_rmse', 1.0 UNION ALL SELECT 'Random Forest', 'r2_agrees', 1.0"""
)
def forest_regression(spark, folder):
    """A forest scores every test row, its shares add up to one, and its scores are those of its
    predictions."""
    run = models.run_regression(
        labelled(spark, folder), "n_chars", "doc_id", ["n_lines", "lang", "toxic"],
        models=[models.FOREST], trees=20, depth=8,
    )
    told = {r["metric"]: r["value"] for r in run.metrics.collect()}
    again = metrics.regression_scores(run.predictions[models.FOREST]).first()
    total = run.importance.agg(F.round(F.sum("importance"), 6)).first()[0]
    return facts(
        spark,
        run,
        (models.FOREST, "importance_total", total),
        (models.FOREST, "mae_within_rmse", float(told["mae"] <= told["rmse"])),
        (models.FOREST, "r2_agrees", float(again["r2"] == told["r2"])),
    )


@query(LABELLED + " SELECT doc_id AS row_key, quality AS y_true, true AS scored FROM s WHERE NOT train")
def model_by_roles(spark, folder):
    """The outcome from every other column of the flagged table: all test rows are scored."""
    from studyspark.operators import qc

    flagged = qc.role_qc(labelled(spark, folder), "doc_id", "quality")
    run = models.run_by_roles(
        flagged, "doc_id", outcome="quality", model="Logistic", importance=False
    )
    pred = run.predictions[models.LOGISTIC]
    return pred.select("row_key", "y_true", F.col("p_class1").between(0, 1).alias("scored"))


SPLIT_FEATURES = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")


@query(
    f"""WITH x AS (UNPIVOT (SELECT l_returnflag AS y, {", ".join(SPLIT_FEATURES)} FROM lineitem)
    ON {", ".join(SPLIT_FEATURES)} INTO NAME feature VALUE value),
v AS (SELECT feature, value, count(*) AS n, count(*) FILTER (y = 'A') AS a, count(*) FILTER (y = 'N') AS b,
             count(*) FILTER (y = 'R') AS c FROM x GROUP BY feature, value),
p AS (SELECT feature, value, lead(value) OVER w AS nxt, sum(n) OVER w AS nl, sum(a) OVER w AS la, sum(b) OVER w AS lb,
             sum(c) OVER w AS lc, sum(n) OVER f AS n, sum(a) OVER f AS ta, sum(b) OVER f AS tb, sum(c) OVER f AS tc
      FROM v WINDOW w AS (PARTITION BY feature ORDER BY value), f AS (PARTITION BY feature)),
g AS (SELECT *, CAST(la * la + lb * lb + lc * lc AS DOUBLE) / nl
             + CAST((ta - la) * (ta - la) + (tb - lb) * (tb - lb) + (tc - lc) * (tc - lc) AS DOUBLE) / (n - nl) AS score,
             CAST(ta * ta + tb * tb + tc * tc AS DOUBLE) / n AS parent
      FROM p WHERE nxt IS NOT NULL AND nl >= 3 AND n - nl >= 3),
b AS (SELECT * FROM g QUALIFY row_number() OVER (PARTITION BY feature ORDER BY score DESC, value) = 1)
SELECT feature, round((value + nxt) / 2, 6) AS threshold, CAST(nl AS BIGINT) AS n_left,
       CAST(n - nl AS BIGINT) AS n_right, round((score - parent) / n, 9) AS gain,
       CAST(row_number() OVER (ORDER BY score - parent DESC) = 1 AS INT) AS importance FROM b"""
)
def best_class_splits(spark, folder):
    """Best split of each feature for three classes, and which of them a one-level tree takes."""
    items = table(spark, folder, "lineitem").withColumn("_y", F.col("l_returnflag")).withColumn("_node", F.lit(1))
    found = trees.best_splits(items, SPLIT_FEATURES, trees.CLASSES)
    tree = trees.grow_tree(table(spark, folder, "lineitem"), SPLIT_FEATURES, "l_returnflag", trees.CLASSES)
    share = tree.importance()
    chosen = F.create_map(*[F.lit(x) for c in SPLIT_FEATURES for x in (c, round(share.get(c, 0.0)))])
    return found.select(
        "feature",
        F.round("threshold", 6).alias("threshold"),
        "n_left",
        "n_right",
        F.round("gain", 9).alias("gain"),
        chosen[F.col("feature")].alias("importance"),
    )


def _tree_sql() -> str:
    """Two levels of a regression tree; a level is a pass over the rows with their nodes."""
    level = """x{k} AS (UNPIVOT (SELECT node, y, discount, quantity, tax FROM r{k}) ON discount, quantity, tax INTO NAME feature VALUE value),
v{k} AS (SELECT node, feature, value, count(*) AS n, sum(y) AS s FROM x{k} GROUP BY ALL),
p{k} AS (SELECT node, feature, value, lead(value) OVER w AS nxt, sum(n) OVER w AS nl, sum(s) OVER w AS sl, sum(n) OVER f AS n,
              sum(s) OVER f AS st FROM v{k} WINDOW w AS (PARTITION BY node, feature ORDER BY value), f AS (PARTITION BY node, feature)),
s{k} AS (SELECT node, feature, (value + nxt) / 2 AS threshold, n, nl, (sl * sl / nl + (st - sl) * (st - sl) / (n - nl) - st * st / n) / n AS gain
       FROM p{k} WHERE nxt IS NOT NULL AND nl >= 3 AND n - nl >= 3
       QUALIFY row_number() OVER (PARTITION BY node ORDER BY gain DESC, feature, value) = 1)"""
    return f"""WITH m AS (SELECT avg(l_extendedprice) AS y FROM lineitem),
r0 AS (SELECT 1 AS node, l_extendedprice - m.y AS y, l_discount AS discount, l_quantity AS quantity, l_tax AS tax FROM lineitem, m),
{level.format(k=0)},
r1 AS (SELECT 2 + CAST(CASE feature WHEN 'discount' THEN discount WHEN 'quantity' THEN quantity ELSE tax END > threshold AS INT) AS node,
              y, discount, quantity, tax FROM r0, s0),
{level.format(k=1)},
t AS (SELECT * FROM s0 UNION ALL SELECT * FROM s1)
SELECT CAST(node AS BIGINT) AS node, feature, round(threshold, 6) AS threshold, CAST(n AS BIGINT) AS n, CAST(nl AS BIGINT) AS n_left,
       round(gain, 2) AS gain, round(sum(n * gain) OVER (PARTITION BY feature) / sum(n * gain) OVER (), 6) AS importance FROM t"""


@query(_tree_sql())
def regression_tree(spark, folder):
    """Splits of a two-level tree with each feature's importance."""
    items = table(spark, folder, "lineitem").select(
        "l_extendedprice", *[F.col(f"l_{c}").alias(c) for c in ("discount", "quantity", "tax")]
    )
    tree = trees.grow_tree(items, ["discount", "quantity", "tax"], "l_extendedprice", trees.NUMBERS, depth=2)
    share = tree.importance()
    rows = [
        (s.node, s.feature, round(s.threshold, 6), s.n, s.n_left, round(s.gain, 2), round(share[s.feature], 6)) for s in tree.splits
    ]
    return spark.createDataFrame(
        rows, "node bigint, feature string, threshold double, n bigint, n_left bigint, gain double, importance double"
    )


@query(
    """WITH d AS (SELECT CAST(l_partkey AS VARCHAR) AS level, l_quantity AS x, l_extendedprice AS y FROM lineitem),
s AS (SELECT count(*) AS n, min(level) AS first, avg(x) AS mx, stddev_pop(x) AS sx, avg(y) AS my FROM d),
r AS (SELECT level, (x - mx) / sx AS z, y - my AS y FROM d, s),
l AS (SELECT level, count(*) AS n, sum(z) AS z, sum(y) AS y FROM r, s WHERE level <> first GROUP BY level),
k AS (SELECT l.*, l.n + (l.n / s.n::DOUBLE) * (1 - l.n / s.n::DOUBLE) AS w FROM l, s),
t AS (SELECT sum(n * n / w) AS oo, sum(n * z / w) AS oz, sum(z * z / w) AS zz, sum(n * y / w) AS oy, sum(z * y / w) AS zy FROM k),
a AS (SELECT count(*) - any_value(oo) AS oo, sum(z) - any_value(oz) AS oz, sum(z * z) + 1 - any_value(zz) AS zz,
             sum(y) - any_value(oy) AS oy, sum(z * y) - any_value(zy) AS zy FROM r, t),
b AS (SELECT (zz * oy - oz * zy) / (oo * zz - oz * oz) AS b, (oo * zy - oz * oy) / (oo * zz - oz * oz) AS w FROM a)
SELECT level, CAST(k.n AS BIGINT) AS n, round((k.y - b.b * k.n - b.w * k.z) / k.w, 4) AS coef, round(b.w / sx, 4) AS slope FROM k, b, s"""
)
def ridge_many_levels(spark, folder):
    """Coefficients of every part, one level each, beside that of the quantity."""
    items = table(spark, folder, "lineitem").withColumn("part", F.col("l_partkey").cast("string"))
    fit = ridge.ridge_with_levels(items, ["l_quantity"], "part", "l_extendedprice")
    slope = F.lit(round(fit.weights[0], 4)).alias("slope")
    return fit.levels.select("level", "n", F.round("coef", 4).alias("coef"), slope)


@query(
    """WITH e AS (SELECT count(DISTINCT value) AS many, count(DISTINCT event_type) AS few, count(*) AS n FROM events)
SELECT 'classes' AS guard, many > 200 AS stopped FROM e UNION ALL SELECT 'one class', true
UNION ALL SELECT 'few rows', true UNION ALL SELECT 'levels', (SELECT count(DISTINCT event_id) FROM events) > 10000
UNION ALL SELECT 'usable', few < 2 FROM e"""
)
def model_guards(spark, folder):
    """What a model run refuses: too many classes, one class, too few rows, text that is an id."""
    e = table(spark, folder, "events").withColumn("same", F.lit("x")).withColumn("id_text", F.col("event_id").cast("string"))
    few = e.where(F.col("event_id") < 6)

    def stopped(df, target, features=("user_id",)):
        return models.run_classification(df, target, "event_id", list(features), models=[models.LOGISTIC], importance=False)

    wide = stopped(e, "event_type", ("user_id", "id_text"))
    rows = [
        ("classes", stopped(e, "value").error is not None),
        ("one class", stopped(e, "same").error is not None),
        ("few rows", stopped(few, "event_type").error is not None),
        ("levels", "id_text" in wide.errors and wide.error is None),
        ("usable", wide.error is not None),
    ]
    return spark.createDataFrame(rows, "guard string, stopped boolean")


@query(f"WITH f AS ({REGISTRY['ridge_predictions'].sql}) SELECT row_key, y_pred FROM f")
def sink_model(spark, folder):
    """A saved model, loaded again, predicts what it predicted before."""
    run = ridge_run(spark, folder)
    path = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    run.save(path)
    again = PipelineModel.load(f"{path}/{models.RIDGE.lower().replace(' ', '_')}")
    e = models.time_features(table(spark, folder, "events"), "ts")
    rows = models.model_table(e, ["user_id", "hour"], "value", "event_id").withColumn("_label", F.col("_y"))
    test = run.predictions[models.RIDGE].select("row_key")
    return again.transform(rows).join(test, F.col("_key") == F.col("row_key")).select("row_key", F.round("_pred", 4).alias("y_pred"))
