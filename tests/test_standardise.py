import datetime as dt

import pytest
from pyspark.sql import functions as F

from studyspark.operators import standardise as st
from studyspark.roles import SESSION_CANDIDATES, guess_columns, guess_roles


def test_names():
    got = st.normal_names([" Step Length (cm) ", "a", "A", "a_1", "%%", "x" * 80])
    assert got == ["step_length_cm", "a", "a_1", "a_1_1", "col_4", "x" * 64]
    assert st.normal_names(["A.b c!", "__X"], "loose") == ["a_b_c_", "__x"]


def test_infer_types(spark):
    rows = [("1", "2020-01-01", "a", "5"), ("2", "2020-02-01", "b", None), ("x", "bad", "c", None), ("4", None, "d", None)]
    got = st.infer_types(spark.createDataFrame(rows, "n string, t string, s string, sparse string"))
    assert [f.dataType.simpleString() for f in got.schema] == ["bigint", "string", "string", "bigint"]
    half = st.infer_types(spark.createDataFrame(rows[:3], "n string, t string, s string, sparse string"))
    assert half.schema["t"].dataType.simpleString() == "timestamp"
    assert half.schema["n"].dataType.simpleString() == "string"


def test_epochs(spark):
    day = dt.datetime(2021, 3, 4)
    secs = int(day.replace(tzinfo=dt.timezone.utc).timestamp())
    df = spark.createDataFrame([(str(secs * 1000), secs, "2021-03-04", 5.0)] * 3, "ms string, s bigint, iso string, small double")
    for c in ("ms", "s", "iso"):
        assert df.select(st.parse_time(df, c).alias("t")).first()["t"] == day
    assert st.time_unit(df, "s", 0.7, 1e12, 1e9) == "s"
    assert st.time_unit(df, "small") == "text"
    even = spark.createDataFrame([(x,) for x in (1.0, 2.0, 1.5e6, 9e6)], "t double")
    assert st.time_unit(even, "t") == "text"  # the limit lies between the middle values
    assert st.time_unit(even.unionByName(even.where("t > 1.5e6")), "t") == "s"


def test_months(spark):
    rows = [("p", "2020-01-01"), ("p", "2020-03-01"), ("q", "2020-05-05"), (None, "2020-05-05"), ("p", "oops")]
    df = spark.createDataFrame(rows, "id string, t string")
    got = {(r[0], r[1]): r[2] for r in st.months_since_baseline(df, "id", "t", "m").collect()}
    assert got == {
        ("p", "2020-01-01"): 0.0,
        ("p", "2020-03-01"): round(60 / 30.44, 2),
        ("q", "2020-05-05"): 0.0,
        (None, "2020-05-05"): None,
        ("p", "oops"): None,
    }


def test_concat_types(spark):
    a = spark.createDataFrame([(1, "x", 1)], "a int, b string, c int")
    b = spark.createDataFrame([(2.5, 3, True)], "a double, b int, d boolean")
    got = st.concat_rows([a, b])
    assert [f.dataType.simpleString() for f in got.schema] == ["double", "string", "int", "boolean"]
    assert sorted(map(tuple, got.collect()), key=repr) == [(1.0, "x", 1, None), (2.5, "3", None, True)]


def test_column_choice(spark):
    df = spark.createDataFrame([(1.0, 1.0, 1.0, 1.0, "t")], "v_mean double, v_mean_ratio double, v_cv double, age double, s string")
    assert st.best_numeric_columns(df) == ["v_mean"]
    assert st.best_numeric_columns(df.drop("v_mean", "v_mean_ratio")) == ["v_cv", "age"]
    low = spark.range(60).select(F.col("id").cast("string").alias("many"), (F.col("id") % 3).cast("string").alias("few"))
    assert st.categorical_candidates(low) == ["few"]
    assert st.is_categorical(low.select(F.col("few").cast("int").alias("few")), "few")
    assert not st.is_categorical(spark.range(60), "id")


def test_sparse(spark):
    df = spark.createDataFrame([(1, None), (2, None), (3, None), (4, None), (5, 1)], "a int, b int")
    kept, dropped = st.drop_sparse_columns(df)
    assert kept.columns == ["a"] and dropped == ["b"]


def test_roles():
    cols = ["visit_date", "patient_id", "sex", "status", "score"]
    r = guess_roles(cols)
    assert (r.entity_id, r.time_col, r.group_col, r.outcome_col, r.target_col) == (
        "patient_id", "visit_date", "sex", "status", "score",
    )
    assert guess_columns(["recordid"], SESSION_CANDIDATES)["session_id"] == "recordid"


def test_empty_concat():
    with pytest.raises(ValueError):
        st.concat_rows([])
