import decimal
import math
import statistics

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from studyspark.functions import signal, tails
from studyspark.functions.coerce import numeric, timestamp_text
from studyspark.functions.guide import expectation
from studyspark.functions.hashing import HIGH_MULTIPLIER, MULTIPLIER, SPAN, spread


def value(spark, col):
    return spark.range(1).select(col.alias("v")).first()["v"]


def test_numeric_text(spark):
    cells = ["12", " 12.5 ", "1d", "NaN", "", "1e3", "-.5", "abc", None, "0x10", "inf"]
    df = spark.createDataFrame([(c,) for c in cells], "c string")
    got = [r[0] for r in df.select(numeric(F.col("c"), T.StringType())).collect()]
    assert got == [12.0, 12.5, None, None, None, 1000.0, -0.5, None, None, None, math.inf]


def test_nan_is_null(spark):
    df = spark.createDataFrame([(float("nan"),), (1.0,)], "c double")
    assert [r[0] for r in df.select(numeric(F.col("c"), T.DoubleType())).collect()] == [None, 1.0]


def test_time_text(spark):
    cells = ["2020-01-05", "05/01/2020", "2020-01-05 10:20:30", "2020", "x", None]
    df = spark.createDataFrame([(c,) for c in cells], "c string")
    got = [r[0] for r in df.select(timestamp_text(F.col("c")).cast("string")).collect()]
    assert got == ["2020-01-05 00:00:00", "2020-05-01 00:00:00", "2020-01-05 10:20:30", None, None, None]


@pytest.mark.parametrize("z", [0.0, 0.3, 1.0, 1.96, 3.5, 6.0])
def test_normal(spark, z):
    assert value(spark, tails.normal_two_sided(F.lit(z))) == pytest.approx(
        math.erfc(z / math.sqrt(2)), rel=2e-7
    )


# Published critical values: (x, df, upper tail).
@pytest.mark.parametrize(
    "x,df,p",
    [(3.841459, 1, 0.05), (5.991465, 2, 0.05), (7.814728, 3, 0.05), (18.307038, 10, 0.05),
     (24.724970, 11, 0.01), (124.342113, 100, 0.05), (287.882, 250, 0.05)],
)
def test_chi2(spark, x, df, p):
    assert value(spark, tails.chi2_upper(F.lit(x), F.lit(df))) == pytest.approx(p, abs=5e-5)


# Published two-sided critical values.
@pytest.mark.parametrize(
    "t,df,p",
    [(12.7062, 1, 0.05), (4.30265, 2, 0.05), (3.18245, 3, 0.05), (2.22814, 10, 0.05),
     (3.10581, 11, 0.01), (1.98397, 100, 0.05), (1.96234, 1000, 0.05), (2.58075, 1000, 0.01)],
)
def test_student(spark, t, df, p):
    assert value(spark, tails.student_two_sided(F.lit(t), F.lit(df))) == pytest.approx(p, abs=2e-6)


def test_student_series_meets_transform(spark):
    inside = value(spark, tails.student_two_sided(F.lit(2.0), F.lit(200)))
    beyond = value(spark, tails.student_two_sided(F.lit(2.0), F.lit(201)))
    assert inside == pytest.approx(beyond, abs=3e-5)
    assert inside > beyond


STAMPS = [
    ("[1, 2.5, 2.0, 4, 5.5, 7]", 6),
    ("[1, 2]", 2),
    ("[1, 2, 4, 7, 11]", 5),
    ("[1, x, 3]", None),
    ("[]", 0),
    (None, None),
]


def test_time_lists(spark):
    df = spark.createDataFrame([(s,) for s, _ in STAMPS], "s string").select(
        signal.time_list(F.col("s")).alias("t")
    )
    rows = df.select("t", signal.gap_sd(F.col("t")).alias("sd"), signal.half_rates(F.col("t")).alias("f")).collect()
    first = sorted([1, 2.5, 2.0, 4, 5.5, 7])
    gap = [b - a for a, b in zip(first, first[1:])]
    assert rows[0]["t"] == first
    assert rows[0]["sd"] == pytest.approx(statistics.pstdev(gap), abs=1e-6)
    assert rows[0]["f"] == pytest.approx(1 / statistics.mean(gap[2:]) - 1 / statistics.mean(gap[:2]), abs=1e-6)
    assert rows[1]["sd"] is None
    assert rows[2]["sd"] == pytest.approx(statistics.pstdev([1, 2, 3, 4]), abs=1e-6)
    assert rows[2]["f"] is None
    assert all(r["sd"] is None and r["f"] is None for r in rows[3:])


def test_equal_stamps_have_no_rate(spark):
    df = spark.createDataFrame([("[1,1,1,1,1,1,1]",)], "s string").select(signal.time_list(F.col("s")).alias("t"))
    r = df.select(signal.gap_sd(F.col("t")), signal.half_rates(F.col("t"))).first()
    assert r[0] == 0.0 and r[1] is None


def test_tap_count(spark):
    cells = ["[1, 2]", "[1]", "300", "301", "abc", None, "12.9", " [1,2,3] ", "[1,"]
    df = spark.createDataFrame([(c,) for c in cells], "c string")
    got = [r[0] for r in df.select(signal.tap_count(F.col("c"), T.StringType())).collect()]
    assert got == [2, None, 300, None, None, None, 12, 3, None]


def test_medication(spark):
    cells = [
        "Just after Parkinson medication (at your best)",
        "Immediately before Parkinson medication",
        "I don't take Parkinson medications",
        "Another time",
        None,
    ]
    df = spark.createDataFrame([(c,) for c in cells], "c string")
    got = [r[0] for r in df.select(signal.medication_state(F.col("c"))).collect()]
    assert got == ["AFTER", "BEFORE", "NO_MEDS", "OTHER", "OTHER"]
    strict = [r[0] for r in df.select(signal.medication_state(F.col("c"), "null")).collect()]
    assert strict[-1] is None


def test_guide_first_entry_wins(spark):
    df = spark.createDataFrame(
        [("Stride_Length_mean",), ("double_support",), ("left_d_support_mean",), ("age",)], "f string"
    )
    got = [r[0] for r in df.select(expectation(F.col("f"))[0]).collect()]
    assert got == ["LOWER in PD", "HIGHER in PD", "HIGHER in PD", "UNKNOWN"]


def test_spread_matches_plain_arithmetic(spark):
    keys = [0, 1, 17, 2**31, 2**32 - 43, 2**32 - 42, 2**40 + 5, -3, 2**63 - 1, 2**63 - 43, -(2**63)]
    df = spark.createDataFrame([(k,) for k in keys], "k bigint")
    got = [r[0] for r in df.select(spread(F.col("k"), T.LongType())).collect()]
    high = [((k + 42) >> 32) % (SPAN >> 1) * HIGH_MULTIPLIER for k in keys]
    assert got == [((k + 42) % SPAN + top) % SPAN * MULTIPLIER % SPAN for k, top in zip(keys, high)]


def plain_chi2(x, df):
    """P(X > x) for even df: e^-h times a finite sum, in forty digits."""
    with decimal.localcontext() as ctx:
        ctx.prec = 40
        h, term, total = decimal.Decimal(x) / 2, decimal.Decimal(1), decimal.Decimal(1)
        for k in range(1, df // 2):
            term = term * h / k
            total += term
        return float(total * (-h).exp())


def plain_student(t, df):
    """P(|T| > t) by the finite series in forty digits."""
    with decimal.localcontext() as ctx:
        ctx.prec = 40
        nu, t = decimal.Decimal(df), decimal.Decimal(t)
        cos2 = nu / (nu + t * t)
        total = term = decimal.Decimal(1)
        for k in range(1, (df - 2) // 2 + 1):
            term = term * cos2 * (2 * k - 1) / (2 * k)
            total += term
        return float(1 - t / (nu + t * t).sqrt() * total)


@pytest.mark.parametrize("df", [2, 4, 10, 48, 50, 200, 202, 5000, 100_000])
def test_tails_of_any_degrees_of_freedom(spark, df):
    spread_of = (2 * df) ** 0.5
    xs = [x for x in (0.3, df - 3 * spread_of, df - 1.0, df, df + 1.0, df + 2 * spread_of, df + 6 * spread_of) if x > 0]
    ts = [0.001, 0.5, 1.0, 1.7, 1.9599, 3.0, 5.0, 12.0]
    df_x = spark.createDataFrame([(float(x), df) for x in xs], "x double, df bigint")
    got = [r[0] for r in df_x.select(tails.chi2_upper(F.col("x"), F.col("df"))).collect()]
    assert got == [pytest.approx(plain_chi2(x, df), rel=1e-9, abs=1e-12) for x in xs]
    df_t = spark.createDataFrame([(t, df) for t in ts], "t double, df bigint")
    got = [r[0] for r in df_t.select(tails.student_two_sided(F.col("t"), F.col("df"))).collect()]
    assert got == [pytest.approx(plain_student(t, df), rel=1e-8, abs=1e-12) for t in ts]


def test_tails_of_odd_and_huge_degrees(spark):
    # published upper points: chi-square 5 %, Student 5 % two-sided
    for df, x in ((1, 3.841458821), (3, 7.814727903), (5, 11.070497694)):
        assert value(spark, tails.chi2_upper(F.lit(x), F.lit(df))) == pytest.approx(0.05, abs=1e-8)
    for df, t in ((61, 1.999624), (101, 1.983731), (10**9, 1.959964)):
        assert value(spark, tails.student_two_sided(F.lit(t), F.lit(df))) == pytest.approx(0.05, abs=5e-7)
    assert value(spark, tails.chi2_upper(F.lit(1e6), F.lit(10**6))) == pytest.approx(0.4998, abs=1e-4)
    assert value(spark, tails.chi2_upper(F.lit(0.0), F.lit(7))) == 1.0
    assert value(spark, tails.chi2_upper(F.lit(1.0), F.lit(0))) is None
    assert value(spark, tails.student_two_sided(F.lit(0.0), F.lit(500))) == 1.0
