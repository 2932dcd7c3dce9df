"""Writers for annotated data, reports, models and chart tables."""

from __future__ import annotations

from collections.abc import Mapping
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from studyspark.operators.models import ModelRun
from studyspark.operators.qc import KEEP
from studyspark.operators.rules import save_config


def write_table(df: DataFrame, path: str, fmt: str = "csv", partition_by: str | None = None) -> None:
    out = df.write.mode("overwrite")
    if partition_by:
        out = out.partitionBy(partition_by)
    if fmt == "csv":
        # a quote inside a cell is written twice, as other tools read it
        out = out.option("header", True).option("escape", '"')
        out = out.option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)
    out.format(fmt).save(path)


def write_annotated(df: DataFrame, folder: str, fmt: str = "csv") -> None:
    """All rows with their flags."""
    write_table(df, f"{folder}/cleaned_qc_dataset", fmt)


def write_kept(df: DataFrame, folder: str, fmt: str = "csv") -> None:
    write_table(df.where(F.col(KEEP).cast("boolean")), f"{folder}/kept", fmt)


def write_qc_log(df: DataFrame, folder: str, fmt: str = "csv") -> None:
    """All rows, one folder per keep flag, so flagged rows can be read alone."""
    write_table(df, f"{folder}/qc_log", fmt, KEEP)


def write_predictions(run: ModelRun, folder: str, fmt: str = "csv") -> None:
    for name, pred in run.predictions.items():
        write_table(pred, f"{folder}/predictions_{name.lower().replace(' ', '_')}", fmt)


def write_report(facts: DataFrame, folder: str, name: str) -> None:
    """Report facts as markdown lines in one text file (a few dozen rows by construction)."""
    from studyspark.plans.report import markdown

    markdown(facts).coalesce(1).write.mode("overwrite").text(f"{folder}/{name}")


def write_charts(charts: Mapping[str, DataFrame], folder: str) -> None:
    for name, table in charts.items():
        write_table(table, f"{folder}/plots/{name}", "parquet")


def write_study(result: Mapping[str, Any], folder: str, config: Mapping[str, Any]) -> None:
    """Everything a study run produced."""
    write_annotated(result["qc"], folder, "parquet")
    write_qc_log(result["qc"], folder, "parquet")
    write_report(result["report"], folder, "insights_report")
    write_charts(result["charts"], folder)
    save_config(result["qc"].sparkSession, config, f"{folder}/config")
    model = result.get("model")
    if model is not None and model.error is None:
        model.save(f"{folder}/model_result")
        write_predictions(model, folder, "parquet")
