"""The whole flow: derive, check, describe, compare, progress, model, report."""

from __future__ import annotations

from collections.abc import Mapping
from typing import Any

from pyspark.sql import DataFrame

from studyspark.operators import charts, qc
from studyspark.operators.compare import annotate_comparison, compare_groups
from studyspark.operators.describe import describe_numeric
from studyspark.operators.lineage import cut
from studyspark.operators.models import run_classification, run_regression
from studyspark.operators.progression import progression_summary, slopes_by_months
from studyspark.operators.rules import apply_rules
from studyspark.operators.standardise import best_numeric_columns
from studyspark.functions.coerce import nulls_for_nans, numeric_columns
from studyspark.plans.report import insight_facts
from studyspark.roles import Roles, guess_roles



def run_study(df: DataFrame, config: Mapping[str, Any], order_cols: list[str]) -> dict[str, Any]:
    """Run a config dict over a table whose rows `order_cols` identify.

    Config: roles (entity_id, time_col, group_col, outcome_col), rules, row_missingness,
    outlier_method, outlier_threshold, duplicate_keys, group_cols, required, qc_columns,
    analysis_columns, histograms, model (task, target, ...). Every numeric column is checked,
    described, compared and drawn unless the config limits them; `required` is the entity and the
    outcome unless given. NaN counts as missing. A model keeps an entity's rows on one side of its
    split unless it is split by time, and ids are no features.
    Returns lazy tables; the annotated table is written once because every step reads it.
    """
    roles = Roles(**{k: config[k] for k in Roles().as_dict() if k in config})
    if roles == Roles():
        roles = guess_roles(df.columns)
    derived, issues = apply_rules(nulls_for_nans(df), config.get("rules", []), config.get("strict", False))
    skip = {roles.entity_id, *order_cols}
    annotated = cut(
        qc.run_qc(
            derived,
            required=config.get(
                "required", [c for c in (roles.entity_id, roles.outcome_col) if c in derived.columns]
            ),
            row_missingness=config.get("row_missingness", 0.8),
            duplicate_keys=config.get("duplicate_keys", []),
            order_cols=order_cols,
            outlier_method=config.get("outlier_method", "iqr"),
            outlier_threshold=config.get("outlier_threshold", 3.0),
            numeric_cols=[c for c in numeric_columns(derived) if c not in skip][
                : config.get("qc_columns")
            ],
        )
    )
    kept = qc.kept_rows(annotated)
    cols = [c for c in best_numeric_columns(kept) if c not in skip][: config.get("analysis_columns")]
    out: dict[str, Any] = {
        "roles": roles,
        "rule_issues": issues,
        "qc": annotated,
        "kept": kept,
        "qc_totals": qc.qc_totals(annotated),
        "reason_counts": qc.reason_counts(annotated),
        "missing_columns": qc.missing_columns(annotated),
        "describe": describe_numeric(kept, cols),
        "charts": {f"hist_{c}": charts.histogram(kept, c, roles.group_col) for c in cols[: config.get("histograms")]},
    }
    compared = progression = None
    groups = [g for g in [roles.group_col, *config.get("group_cols", [])] if g]
    for g in groups:
        got = compare_groups(kept, [c for c in cols if c != g], g)
        out[f"compare_{g}"] = annotate_comparison(got)
        out["charts"][f"effects_{g}"] = charts.effect_bars(got)
        compared = got if compared is None else compared
    if roles.entity_id and roles.time_col and roles.outcome_col in numeric_columns(kept):
        per = cut(slopes_by_months(kept, roles.entity_id, roles.time_col, roles.outcome_col))
        progression = progression_summary(per)
        out["slopes"], out["progression"] = per, progression
        out["charts"]["slopes"] = charts.histogram(per, "slope", bins=25)
        if roles.group_col:
            out["charts"]["slopes_by_group"] = charts.slopes_by_group(
                per, kept, roles.entity_id, roles.group_col
            )
    out["report"] = insight_facts(annotated, out["describe"], compared, progression)
    model = config.get("model")
    if model:
        fit = run_regression if model["task"] == "regression" else run_classification
        options = {k: v for k, v in model.items() if k not in ("task", "target")}
        if roles.entity_id and not options.get("time_col"):
            options.setdefault("entity", roles.entity_id)
        options.setdefault("exclude", [c for c in (roles.entity_id, roles.time_col, *order_cols) if c])
        out["model"] = fit(kept, model["target"], order_cols[0], **options)
    return out
