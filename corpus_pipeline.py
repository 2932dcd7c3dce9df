"""Clean a corpus in stages: each reads what the one before it kept, written as Parquet.

Every stage takes (spark, docs, sf_dir) and returns the columns of `docs`; the last one adds what the
mix takes. Rows with null text or without words pass through all stages but the last, which gives
them nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from studyspark.llm.base import TextQuery, table
from studyspark.llm.decontam import drop_contaminated
from studyspark.llm.linededup import drop_repeated_lines
from studyspark.llm.mixing import mix_sources
from studyspark.llm.neardup import keep_one
from studyspark.llm.toxicity import drop_toxic
from studyspark.operators.lineage import cut


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the weakly supervised classifier calls toxic go."""
    return drop_toxic(docs, table(spark, sf_dir, "labels"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of repeated line runs go; a document that they were all of goes with them.

    `n_chars`, where there is such a column, follows the text.
    """
    found = drop_repeated_lines(docs)
    left = found.where((F.col("n_deleted") == 0) | (F.length(F.trim("text")) > 0))
    changed = {"text": F.col("text"), "n_chars": F.length("text").cast("bigint")}
    return left.select(
        *[
            F.when(F.col("n_deleted") > 0, changed[c]).otherwise(F.col(f"row.`{c}`")).alias(c)
            if c in changed
            else F.col(f"row.`{c}`")
            for c in docs.columns
        ]
    )


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays: five words, similarity 0.8."""
    return keep_one(docs, words=5, percent=80)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, re-parameterised or not, go."""
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the mix takes words from, with `size`, `target` and `taken`."""
    added = ("size", "target", "taken")
    mixed = mix_sources(docs).where(F.col("taken") > 0)
    return mixed.select(*[F.col(f"row.`{c}`") for c in docs.columns if c not in added], *added)


STAGES = [
    ("toxicity", toxicity),
    ("line dedup", line_dedup),
    ("near dedup", near_dedup),
    ("decontamination", decontaminate),
    ("mixing", mix),
]

# Learnt scores decide the first stage, which SQL can't state; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)


PIPELINE = {"pipeline": TextQuery(run, ORACLE_SQL)}
