"""Registry of the text queries and helpers that every operator here shares."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class TextQuery:
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None


REGISTRY: dict[str, TextQuery] = {}


def query(sql: str | None = None):
    """Register a function under its own name."""

    def add(fn):
        REGISTRY[fn.__name__] = TextQuery(fn, sql)
        return fn

    return add


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def id_remainder(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo `modulus`; a null id counts as empty text."""
    text = F.coalesce(doc_id.cast("string"), F.lit(""))
    return F.crc32(text.cast("binary")) % F.lit(modulus)


def text_key(id_col: Column, text: Column) -> Column:
    """Names a row by its id and a hash of its text; rows with equal keys are copies."""
    return F.struct(id_col.alias("id"), F.xxhash64(text).alias("th"))


def packed(df: DataFrame, **extra: Column) -> DataFrame:
    """The whole row as one struct `row`, beside the given columns.

    Columns that a caller's table has besides the documented ones can't clash with the names an
    operator uses inside.
    """
    cols = [c.alias(name) for name, c in extra.items()]
    return df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), *cols)


def unpacked(df: DataFrame, *extra: Column) -> DataFrame:
    return df.select("row.*", *extra)
