"""Writers: what is read back equals what was written."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from studyspark.catalog.base import REGISTRY, query, table
from studyspark.catalog.modelling import RIDGE, ridge_run
from studyspark.catalog.quality import FLAGS, flagged_visits
from studyspark.operators.lineage import shared_folder
from studyspark.operators.models import RIDGE as RIDGE_NAME
from studyspark.plans import report
from studyspark.sources import sinks
from studyspark.sources.delimited import read_study


def _folder(spark) -> str:
    return f"{shared_folder(spark)}/{uuid.uuid4().hex}"


@query(FLAGS + " SELECT event_id, user_id, value, qc_keep, qc_reason FROM qc")
def sink_annotated(spark, folder):
    """All rows with their flags as delimited text."""
    path = _folder(spark)
    sinks.write_annotated(flagged_visits(spark, folder), path)
    back = spark.read.option("header", True).option("escape", '"').csv(f"{path}/cleaned_qc_dataset")
    return back.select(
        F.col("event_id").cast("bigint").alias("event_id"),
        F.col("user_id").cast("bigint").alias("user_id"),
        F.col("value").cast("double").alias("value"),
        F.col("qc_keep").cast("boolean").alias("qc_keep"),
        F.coalesce("qc_reason", F.lit("")).alias("qc_reason"),
    )


@query(
    """SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'say "' || event_type || '", now'
  WHEN 1 THEN event_type || chr(10) || user_id || chr(10) WHEN 2 THEN event_type || ' \\'
  ELSE '[{"a":' || user_id || '},{"b":"' || event_type || '"}]' END AS note, user_id FROM events"""
)
def csv_quoted_cells(spark, folder):
    """Cells with doubled quotes, separators, line breaks and backslashes, written and read again."""
    path = _folder(spark)
    kind, user = F.col("event_type"), F.col("user_id").cast("string")
    note = (
        F.when(F.col("event_id") % 4 == 0, F.concat(F.lit('say "'), kind, F.lit('", now')))
        .when(F.col("event_id") % 4 == 1, F.concat(kind, F.lit("\n"), user, F.lit("\n")))
        .when(F.col("event_id") % 4 == 2, F.concat(kind, F.lit(" \\")))
        .otherwise(F.concat(F.lit('[{"a":'), user, F.lit('},{"b":"'), kind, F.lit('"}]')))
    )
    sinks.write_table(table(spark, folder, "events").select("event_id", note.alias("note"), "user_id"), path)
    rows, rejects = read_study(spark, [path])
    return rows.select("event_id", "note", "user_id").unionByName(
        rejects.select(F.lit(None).cast("bigint").alias("event_id"), F.col("line").alias("note"), F.lit(None).cast("bigint").alias("user_id"))
    )


@query(FLAGS + " SELECT event_id, value FROM qc WHERE qc_keep")
def sink_kept(spark, folder):
    path = _folder(spark)
    sinks.write_kept(flagged_visits(spark, folder), path, "parquet")
    return spark.read.parquet(f"{path}/kept").select("event_id", "value")


@query(FLAGS + " SELECT event_id, qc_reason FROM qc WHERE NOT qc_keep")
def sink_qc_log(spark, folder):
    """The flagged rows alone, from their own partition."""
    path = _folder(spark)
    sinks.write_qc_log(flagged_visits(spark, folder), path, "parquet")
    log = spark.read.parquet(f"{path}/qc_log")
    return log.where(~F.col("qc_keep").cast("boolean")).select("event_id", "qc_reason")


@query(
    f"""WITH f AS ({REGISTRY["report_qc"].sql})
SELECT DISTINCT '## ' || section AS line FROM f UNION ALL SELECT '- ' || key || ': ' || value FROM f"""
)
def sink_report(spark, folder):
    """A report as lines of text."""
    path = _folder(spark)
    sinks.write_report(report.qc_facts(flagged_visits(spark, folder)), path, "qc_report")
    lines = spark.read.text(f"{path}/qc_report").select(F.col("value").alias("line"))
    return lines.where("line <> ''")


@query(RIDGE + " SELECT event_id AS row_key, y AS y_true, round(yp, 4) AS y_pred FROM p")
def sink_predictions(spark, folder):
    path = _folder(spark)
    sinks.write_predictions(ridge_run(spark, folder), path, "parquet")
    name = RIDGE_NAME.lower().replace(" ", "_")
    back = spark.read.parquet(f"{path}/predictions_{name}")
    return back.withColumn("y_pred", F.round("y_pred", 4))
