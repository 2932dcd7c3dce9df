"""Train/test splits as row predicates.

A split is decided by one exact cut value (per stratum), found by rank selection and frozen as a
literal. The row pass is then a plain filter: no window, sort or join over the table.
"""

from __future__ import annotations

import math

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from studyspark.functions.coerce import is_numeric, numeric_of
from studyspark.functions.hashing import part_of, spread
from studyspark.operators.order import bucket_depth, hash_bucket, kth_values, profile_values

TRAIN, TEST = "train", "test"
# Up to so many cuts stand in the plan as literals; more are joined. The split is the same.
LITERAL_CUTS = 50


def _time_value(df: DataFrame, col: str) -> Column:
    dtype = df.schema[col].dataType
    if isinstance(dtype, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return F.unix_micros(F.col(col).cast("timestamp")).cast("double")
    return numeric_of(df, col)


def _kth(rows: DataFrame, k: int):
    """(value, before) at 0-based position k of `value` (any numeric type)."""
    rows = rows.select(F.lit("x").alias("feature"), "value", F.col("value").cast("double").alias("d"))
    edges = profile_values(rows, ["d"]).edges["d"]
    cut = Bucketizer(
        inputCol="d", outputCol="b", splits=[-math.inf, *edges, math.inf], handleInvalid="keep"
    )
    rows = cut.transform(rows).withColumn("_bucket", F.coalesce(F.col("b").cast("int"), F.lit(0)))
    ask = lambda _: F.array(F.struct(F.lit(k).cast("bigint").alias("k")))
    got = kth_values(rows, ["feature"], ask, True).first()
    return got["value"], got["before"]


def time_split(
    df: DataFrame, time: str, key: str, test_share: float = 0.2, output: str = "split"
) -> DataFrame:
    """Earliest rows train. Unreadable times come last; `key` (unique, numeric) breaks ties."""
    if not is_numeric(df.schema[key].dataType):
        raise ValueError("time_split needs a numeric row key")
    t = _time_value(df, time)
    n, timed = df.agg(F.count("*"), F.count(t)).first()
    cut = int(n * (1 - test_share))
    if cut <= 0:
        return df.withColumn(output, F.lit(TEST))
    if cut > timed:
        at = F.lit(True)
        tied, before = df.where(t.isNull()), timed
        earlier = t.isNotNull()
        at = t.isNull()
    else:
        value, before = _kth(df.select(t.alias("value")).where("value is not null"), cut - 1)
        earlier = F.coalesce(t < F.lit(value), F.lit(False))
        at = F.coalesce(t == F.lit(value), F.lit(False))
        tied = df.where(at)
    last, _ = _kth(tied.select(F.col(key).alias("value")), cut - before - 1)
    train = earlier | (at & (F.col(key) <= F.lit(last)))
    return df.withColumn(output, F.when(train, F.lit(TRAIN)).otherwise(F.lit(TEST)))


def random_split(
    df: DataFrame,
    key: str,
    test_share: float = 0.2,
    seed: int = 42,
    stratum: str | None = None,
    output: str = "split",
) -> DataFrame:
    """Hash-ordered split, the same for every run; exact counts overall or in each stratum.

    `key` must identify a row. Strata may be any number; a null stratum is one too.
    """
    dtype = df.schema[key].dataType
    h = spread(F.col(key), dtype, seed)
    depth = max(bucket_depth(df), 12)
    part = F.col(stratum) if stratum else F.lit("all")
    rows = df.select(part.alias("s"), h.alias("h"), F.col(key).alias("id")).select(
        "s", F.struct("h", "id").alias("value"), hash_bucket(F.col("h"), depth).alias("_bucket")
    )
    def ask(total: Column) -> Column:
        k = F.floor(total * (1 - test_share)).cast("bigint") - 1
        return F.array(F.struct(k.alias("k")))

    if stratum and df.select(stratum).distinct().limit(LITERAL_CUTS + 1).count() > LITERAL_CUTS:
        cuts = kth_values(rows, ["s"], ask, False).select(F.struct("s").alias("_part"), "value")
        joined = df.withColumn("_part", F.struct(F.col(stratum).alias("s"))).join(cuts, "_part", "left")
        early = (h < F.col("value.h")) | ((h == F.col("value.h")) & (F.col(key) <= F.col("value.id")))
        side = F.when(F.coalesce(early, F.lit(False)), F.lit(TRAIN)).otherwise(F.lit(TEST))
        return joined.withColumn(output, side).select(*df.columns, output)
    train = F.lit(False)
    for r in kth_values(rows, ["s"], ask, True).collect():
        hash_cut, key_cut = r["value"]["h"], r["value"]["id"]
        first = (h < hash_cut) | ((h == hash_cut) & (F.col(key) <= F.lit(key_cut)))
        here = F.col(stratum).eqNullSafe(F.lit(r["s"])) if stratum else F.lit(True)
        train = train | (here & first)
    return df.withColumn(output, F.when(train, F.lit(TRAIN)).otherwise(F.lit(TEST)))


def fold_of(df: DataFrame, entity: str, folds: int, seed: int = 42) -> Column:
    """Fold number shared by all rows of an entity."""
    return part_of(spread(F.col(entity), df.schema[entity].dataType, seed), folds)


def entity_split(
    df: DataFrame, entity: str, test_folds: int = 1, folds: int = 5, seed: int = 42, output="split"
) -> DataFrame:
    """No entity is in both parts; no shuffle."""
    test = fold_of(df, entity, folds, seed) < test_folds
    return df.withColumn(output, F.when(test, F.lit(TEST)).otherwise(F.lit(TRAIN)))
