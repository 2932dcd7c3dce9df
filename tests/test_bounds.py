"""Hashes, strata and bounds that must hold whatever the keys are."""

from pyspark.sql import functions as F
from pyspark.sql import types as T

from studyspark.functions.hashing import SPAN, part_of, spread
from studyspark.operators import keyed, order, splits
from studyspark.operators.models import default_features


def test_row_ids_of_many_partitions_spread(spark):
    ids = spark.range(0, 8000, 1, 200).select(F.monotonically_increasing_id().alias("id"))
    h = spread(F.col("id"), T.LongType())
    got = ids.select(h.alias("h"), part_of(h, 4).alias("p"), part_of(h, 32).alias("q"))
    assert got.select("h").distinct().count() > 7990
    assert got.where((F.col("h") < 0) | (F.col("h") >= SPAN)).count() == 0
    assert all(1600 < r["count"] < 2400 for r in got.groupBy("p").count().collect())
    assert all(120 < r["count"] < 400 for r in got.groupBy("q").count().collect())


def test_folds_are_no_residue_of_the_key(spark):
    df = spark.range(4000)
    folds = df.select((F.col("id") % 4).alias("r"), splits.fold_of(df, "id", 4).alias("f"))
    assert folds.groupBy("r", "f").count().count() == 16


def test_many_strata_split_like_few(spark):
    df = spark.range(3000).select("id", (F.col("id") % 100).alias("s"))
    got = splits.random_split(df, "id", 0.2, stratum="s")
    sizes = got.where("split = 'train'").groupBy("s").count().collect()
    assert len(sizes) == 100 and all(r["count"] == 24 for r in sizes)
    few = df.where("s < 10")
    want = {r["id"]: r["split"] for r in splits.random_split(few, "id", 0.2, stratum="s").collect()}
    assert {r["id"]: r["split"] for r in got.where("s < 10").collect()} == want


def test_hot_keys_are_named(spark):
    assert keyed.HOT_LIMIT >= 1 / keyed.HOT_SHARE
    df = spark.range(3000).select(F.when(F.col("id") < 1000, F.lit(0)).otherwise(F.col("id")).alias("k"))
    assert len(keyed.profile_keys(df, ["k"], hot_min_rows=500).hot) == 1


def test_buckets_follow_the_session(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "10000")
        assert order.bucket_depth(spark.range(1)) == 16
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_keys_and_flags_are_no_features(spark):
    df = spark.createDataFrame([(1, 2, 3, 1, 5.0)], "_row_id int, pid int, age int, qc_keep int, y double")
    assert default_features(df, "y", ["_row_id", "pid", None]) == ["age"]
