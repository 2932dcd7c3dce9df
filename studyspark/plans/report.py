"""Reports as a small facts table (section, ord, key, value)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from studyspark.operators import describe, qc
from studyspark.operators.compare import annotate_comparison, top_effects
from studyspark.operators.models import ModelRun

LIMITATIONS = (
    "Observational data: differences between groups are not effects of the group.",
    "Few rows or few entities make tests weak and estimates unstable.",
    "Missing values and flagged rows can bias every table above.",
    "Models are exploratory and are not valid for clinical use.",
)
SCHEMA = "section string, ord int, key string, value string"


def _facts(df: DataFrame, section: str, key: Column, value: Column, order: list[Column]) -> DataFrame:
    """Number a bounded result; callers pass at most a few dozen rows."""
    return df.select(
        F.lit(section).alias("section"),
        F.row_number().over(Window.orderBy(*order)).alias("ord"),
        key.alias("key"),
        value.cast("string").alias("value"),
    )


def _one_row(df: DataFrame, section: str) -> DataFrame:
    """One-row tables: a fact per column."""
    cols = [
        F.struct(
            F.lit(section).alias("section"),
            F.lit(i + 1).alias("ord"),
            F.lit(c).alias("key"),
            F.col(c).cast("string").alias("value"),
        )
        for i, c in enumerate(df.columns)
    ]
    return df.select(F.inline(F.array(*cols)))


def _fixed(spark: SparkSession, section: str, pairs) -> DataFrame:
    rows = [(section, i + 1, str(k), None if v is None else str(v)) for i, (k, v) in enumerate(pairs)]
    return spark.createDataFrame(rows, SCHEMA)


def _stack(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def qc_facts(annotated: DataFrame, top: int = 10) -> DataFrame:
    """Totals, most frequent reasons and sparsest columns."""
    reasons = qc.reason_counts(annotated, top)
    sparse = qc.missing_columns(annotated, top=top)
    return _stack(
        [
            _one_row(qc.qc_totals(annotated), "qc"),
            _facts(reasons, "qc_reasons", F.col("reason"), F.col("n_removed"), [F.desc("n_removed"), F.col("reason")]),
            _facts(sparse, "qc_missing", F.col("column"), F.col("missing_pct"), [F.desc("missing_pct"), F.col("column")]),
        ]
    )


def insight_facts(
    annotated: DataFrame | None,
    described: DataFrame,
    compared: DataFrame | None = None,
    progression: DataFrame | None = None,
) -> DataFrame:
    """The study report: QC, describe table, five largest effects, progression, limitations."""
    spark = described.sparkSession
    if annotated is None:
        empty = [(c, None) for c in ("total", "kept", "removed", "kept_pct")]
        parts = [_fixed(spark, "qc", empty)]
    else:
        parts = [qc_facts(annotated, 5)]
    line = F.format_string(
        "mean=%s, SD=%s, median=%s, missing=%s%%",
        *[F.col(c).cast("string") for c in ("mean", "sd", "median", "missing_pct")],
    )
    parts.append(_facts(described, "describe", F.col("column"), line, [F.col("column")]))
    if compared is not None:
        best = annotate_comparison(top_effects(compared, 5))
        star = F.when(F.col("is_significant"), F.lit("significant")).otherwise(F.lit("not significant"))
        text = F.concat_ws(
            "; ",
            F.concat(F.lit("effect="), F.col("effect_size").cast("string")),
            F.col("effect_label"),
            F.concat(F.lit("p="), F.col("p_value").cast("string")),
            star,
            F.concat(F.lit("expected="), F.col("expected")),
        )
        order = [F.desc_nulls_last("effect_size"), F.col("feature")]
        parts.append(_facts(best, "compare", F.col("feature"), text, order))
    if progression is not None:
        parts.append(_one_row(progression, "progression"))
    parts.append(_fixed(spark, "limitations", enumerate(LIMITATIONS, 1)))
    return _stack(parts)


def model_facts(spark: SparkSession, run: ModelRun) -> DataFrame:
    """Task, split, sizes, metrics and the ten largest importances per model, or the error."""
    if run.error:
        return _fixed(spark, "model", [("task", run.task), ("error", run.error)])
    keys = ("task", "split_type", "n_train", "n_test", "target_mean", "best_model", "rare_classes")
    parts = [_fixed(spark, "model", [(k, run.summary[k]) for k in keys if k in run.summary])]
    key = F.concat_ws(": ", "model", "metric")
    parts.append(_facts(run.metrics, "metrics", key, F.col("value"), [F.col("model"), F.col("metric")]))
    if run.importance is not None:
        head = run.importance.where("ord <= 10")
        key = F.concat_ws(": ", "model", "feature")
        value = F.round("importance", 4)
        parts.append(_facts(head, "importance", key, value, [F.col("model"), F.col("ord")]))
    return _stack(parts)


def auto_facts(
    annotated: DataFrame,
    group: str | None = None,
    outcome: str | None = None,
    time: str | None = None,
) -> DataFrame:
    """Missing columns, rows kept, outcome values, group shares and rows per month."""
    kept = annotated.where(F.col(qc.KEEP).cast("boolean"))
    sparse = qc.missing_columns(annotated, above=None)
    parts = [
        _facts(sparse, "missing", F.col("column"), F.col("missing_pct"), [F.desc("missing_pct"), F.col("column")]),
        _one_row(qc.qc_totals(annotated), "rows"),
    ]
    if outcome:
        top = describe.top_values(kept, outcome, 12)
        order = [F.col("is_rest"), F.desc("n"), F.asc_nulls_last("value")]
        parts.append(_facts(top, "outcome", F.col("value"), F.col("n"), order))
    if group and outcome:
        found = kept.select(outcome).where(F.col(outcome).isNotNull()).distinct().limit(3).count()
        if found == 2:
            share = describe.positive_share(kept, group, outcome)
            parts.append(_facts(share, "positive_share", F.col(group).cast("string"), F.col("positive_share"), [F.col(group)]))
    if time:
        months = describe.rows_per_month(kept, time)
        parts.append(_facts(months, "months", F.col("month"), F.col("n"), [F.col("month")]))
    reasons = qc.reason_counts(annotated, 10)
    parts.append(
        _facts(reasons, "qc_reasons", F.col("reason"), F.col("n_removed"), [F.desc("n_removed"), F.col("reason")])
    )
    return _stack(parts)


def markdown(facts: DataFrame) -> DataFrame:
    """One text line per fact, a heading per section."""
    first = F.row_number().over(Window.partitionBy("section").orderBy("ord")) == 1
    head = F.when(first, F.concat(F.lit("## "), F.col("section"), F.lit("\n")))
    body = F.concat(F.lit("- "), F.coalesce("key", F.lit("")), F.lit(": "), F.coalesce("value", F.lit("")))
    return facts.select("section", "ord", F.concat_ws("\n", head, body).alias("value")).orderBy(
        "section", "ord"
    ).select("value")
