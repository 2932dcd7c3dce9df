import pytest
from pyspark.sql import functions as F

from studyspark.operators import qc, sessions

# Sessions retyped from the shape of a cleaned tapping export.
SESSIONS = [
    ("P0001", "S1", 20.10, 120, "control"),
    ("P0001", "S2", 18.99, 110, "control"),
    ("P0002", "S3", 19.00, 90, "off"),
    ("P0002", "S4", 19.50, 100, "on"),
]


def reasons(df, key="id"):
    return {r[key]: r["qc_reason"] for r in df.collect()}


@pytest.fixture(scope="module")
def visits(spark):
    rows = [(i, f"p{i % 5}", float(i), None) for i in range(12)]
    rows += [(12, None, 5.0, None), (13, "p0", 500.0, None), (14, "p1", None, None)]
    return spark.createDataFrame(rows, "id int, pid string, x double, empty double")


def test_order_of_reasons(visits):
    got = qc.run_qc(
        visits, required=["gone", "pid", "x"], row_missingness=0.4, duplicate_keys=["pid"],
        order_cols=["id"], numeric_cols=["x", "absent"],
    )
    r = reasons(got)
    assert r[0] == "missing_required_col:gone"
    assert r[5] == "missing_required_col:gone,duplicate_key"
    assert r[12] == "missing_required_col:gone,null_required:pid,high_row_missingness"
    assert r[13] == "missing_required_col:gone,duplicate_key,outlier:x"
    assert r[14] == "missing_required_col:gone,null_required:x,high_row_missingness,duplicate_key"
    assert got.count() == visits.count()
    assert got.where("qc_keep != (qc_reason = '')").count() == 0


def test_null_keys_are_equal(spark):
    df = spark.createDataFrame([(1, None, "a"), (2, None, "a"), (3, None, "b")], "id int, k string, j string")
    got = reasons(qc.run_qc(df, duplicate_keys=["k", "j", "absent"], order_cols=["id"]))
    assert got == {1: "", 2: "duplicate_key", 3: ""}


def test_several_order_columns(spark):
    df = spark.createDataFrame([(1, "b", 1), (2, "a", 1), (3, "a", 2)], "id int, o string, k int")
    got = reasons(qc.run_qc(df, duplicate_keys=["k"], order_cols=["o", "id"]))
    assert got == {1: "duplicate_key", 2: "", 3: ""}


def test_outlier_limits(spark):
    nine = spark.range(9).select("id", F.when(F.col("id") == 8, 1e9).otherwise(1.0).alias("x"))
    assert set(reasons(qc.run_qc(nine, numeric_cols=["x"])).values()) == {""}
    flat = spark.range(20).select("id", F.when(F.col("id") == 0, 2.0).otherwise(1.0).alias("x"))
    assert reasons(qc.run_qc(flat, numeric_cols=["x"]))[0] == "outlier:x"  # zero spread still flags
    const = spark.range(20).select("id", F.lit(1.0).alias("x"))
    assert set(reasons(qc.run_qc(const, numeric_cols=["x"], outlier_method="zscore")).values()) == {""}
    z = spark.range(30).select("id", F.when(F.col("id") == 0, 100.0).otherwise(F.col("id") % 3).alias("x"))
    assert reasons(qc.run_qc(z, numeric_cols=["x"], outlier_method="zscore"))[0] == "outlier:x"


def test_old_flags_are_replaced(spark):
    df = spark.createDataFrame([(1, "old", False)], "id int, qc_reason string, qc_keep boolean")
    got = qc.run_qc(df, row_missingness=0.0)
    assert got.columns == ["id", "qc_reason", "qc_keep"] and reasons(got) == {1: ""}


def test_duplicates_need_an_order(spark):
    with pytest.raises(ValueError):
        qc.run_qc(spark.range(2), duplicate_keys=["id"])


def test_session_checks(spark):
    rows = [
        ("a", "s", 10.0, 50), (" ", None, 10.0, 50), ("a", "s", 0.0, 5), ("a", "s", -1.0, 5),
        ("a", "s", 4.9, 5), ("a", "s", 60.1, 5), ("a", "s", None, 5), ("a", "s", 10.0, None), ("a", "s", 10.0, 101),
        ("a", "s", 5.0, 50), ("a", "s", 60.0, 50),
    ]
    df = spark.createDataFrame(rows, "pid string, session_id string, duration_sec double, tap_cnt int").withColumn("id", F.monotonically_increasing_id())
    df = df.withColumn("tap_hz", F.when(F.col("duration_sec") > 0, F.col("tap_cnt") / F.col("duration_sec"))).coalesce(1).orderBy("id")
    out = "duration_out_of_range(5.0-60.0)"
    got = [r["qc_reason"] for r in qc.session_qc(df, require_tap_rate=True).collect()]
    assert got == [
        "OK", "missing_pid,missing_session_id", f"nonpositive_duration,{out},missing_tap_hz",
        f"nonpositive_duration,{out},missing_tap_hz", out, out, "missing_duration,missing_tap_hz",
        "missing_tap_cnt_for_rate_qc", "tap_hz_too_high(>10.0)", "OK", "OK",
    ]
    split = qc.split_qc(qc.session_qc(df))
    assert split.kept.count() + split.removed.count() == split.full.count() == len(rows)
    top = split.breakdown.first()
    assert (top["reason"], top["n_removed"]) == (out, 4)


def test_short_sessions(spark):
    df = spark.createDataFrame(SESSIONS, "pid string, id string, duration_sec double, tap_cnt int, pd_state string")
    got = {r["id"]: (r["qc_reason"], r["qc_keep"]) for r in qc.short_session_qc(df, "duration_sec").collect()}
    assert got["S2"] == ("short_duration", 0) and got["S3"] == ("", 1)


def test_summaries(visits, spark):
    got = qc.run_qc(visits, required=["pid"], duplicate_keys=["pid"], order_cols=["id"])
    t = qc.qc_totals(got).first()
    assert t["total"] == 15 and t["kept"] + t["removed"] == 15
    assert t["kept_pct"] == round(100 * t["kept"] / 15, 1)
    assert qc.kept_rows(got).columns == visits.columns
    m = qc.missing_columns(got).collect()
    assert [(r["column"], r["missing_pct"]) for r in m] == [("empty", 100.0)]
    none = qc.qc_totals(got.where("1 = 0")).first()
    assert (none["total"], none["kept"], none["kept_pct"]) == (0, 0, 0.0)


def test_clean_sessions_unmapped(spark):
    df = spark.createDataFrame([("x",)], "other string")
    row = sessions.clean_sessions(df, {}).full.first()
    assert row["pid"] == "" and row["dx_proxy"] is None and row["tap_hz"] is None
    assert row["qc_reason"] == "missing_pid,missing_session_id,missing_duration"
    assert row.asDict().keys() >= set(sessions.ANALYSIS_COLUMNS)
