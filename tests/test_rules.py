import pytest
from pyspark.sql import functions as F

from studyspark.operators import rules

MAP = rules.parse_keyword_mappings("before, pre, off → BEFORE\nafter, post, on -> AFTER\n\nnone, no med, control -> NO_MEDS\nbroken line")


def column(df, rule, **kw):
    out, issues = rules.apply_rules(df, [rule], **kw)
    assert issues == []
    return [r[rule["output_col"]] for r in out.collect()]


def test_parse_mappings():
    assert [m["label"] for m in MAP] == ["BEFORE", "AFTER", "NO_MEDS"]
    assert MAP[2]["keywords"] == ["none", "no med", "control"]


def test_keywords_first_mapping_wins(spark):
    df = spark.createDataFrame([("OFF meds",), ("none",), ("control",), (None,), ("zzz",), ("off then on",)], "m string")
    rule = {"type": "keyword_map", "source_col": "m", "output_col": "s", "mappings": MAP, "default": "OTHER"}
    assert column(df, rule) == ["BEFORE", "AFTER", "AFTER", "OTHER", "OTHER", "BEFORE"]
    assert column(df, {**rule, "match": "word"}) == ["BEFORE", "NO_MEDS", "NO_MEDS", "OTHER", "OTHER", "BEFORE"]
    assert column(df, {**rule, "source_col": "absent"}) == ["OTHER"] * 6
    dotted = {**rule, "mappings": [{"keywords": ["o.f"], "label": "X"}]}
    assert column(df, dotted) == ["OTHER"] * 6


def test_bins(spark):
    df = spark.createDataFrame([(x,) for x in ("0", "50", "65", "999", "1000", "text", None, "0.5")], "age string")
    rule = {"type": "numeric_bin", "source_col": "age", "output_col": "band", "bins": [0, 50, 65, 999], "labels": ["<50", "50-65", "65+"]}
    assert column(df, rule) == [None, "<50", "50-65", "65+", None, None, None, "<50"]


def test_lookup(spark):
    df = spark.createDataFrame([("NO_MEDS",), ("x",), (None,)], "s string")
    rule = {"type": "proxy_label", "source_col": "s", "output_col": "d", "mapping": {"NO_MEDS": "Control", "__default__": "PD"}}
    assert column(df, rule) == ["Control", "PD", "PD"]
    assert column(df, {**rule, "mapping": {"x": "y"}}) == ["Unknown", "y", "Unknown"]
    assert column(df, {**rule, "source_col": "absent"}) == ["PD"] * 3


def test_formula(spark):
    df = spark.createDataFrame([(10.0, 4.0, "3"), (7.0, 0.0, "x")], "a double, b double, t string")
    f = lambda e: column(df, {"type": "formula", "output_col": "o", "expression": e})
    assert f("a / b") == [2.5, None]
    assert f("-(a + 2) * 2 ** 3") == [-96.0, -72.0]
    assert f("a // b") == [2.0, None]
    assert f("t + 1") == [4.0, None]
    assert f("1.5") == [1.5, 1.5]


@pytest.mark.parametrize("bad", ["a; b", "__import__('os')", "a.b", "f(a)", "missing + 1", "a +", "a < b", "a if b"])
def test_formula_rejects(spark, bad):
    df = spark.createDataFrame([(1.0, 2.0)], "a double, b double")
    out, issues = rules.apply_rules(df, [{"type": "formula", "output_col": "o", "expression": bad}])
    assert len(issues) == 1 and out.columns == ["a", "b"]
    with pytest.raises(rules.RuleError):
        rules.apply_rules(df, [{"type": "formula", "output_col": "o", "expression": bad}], strict=True)


def test_validate():
    got = rules.validate_rules([{"output_col": "x"}, {"type": "formula"}, {"type": "odd", "output_col": "y", "source_col": "q"}], ["a"])
    assert got == [
        "rule 0 has no type",
        "rule 1 has no output_col",
        "rule 2 is of no known type: odd",
        "rule 2 names a column that is not there: q",
    ]


def test_config_round_trip(spark, tmp_path):
    config = {"entity_id": "pid", "rules": [{"type": "formula", "output_col": "o", "expression": "a"}]}
    rules.save_config(spark, config, str(tmp_path / "c"))
    assert rules.load_config(spark, str(tmp_path / "c")) == config


def test_stateless_rules_stream(spark, tmp_path):
    """Row rules are plain columns, so they also apply to a streaming table."""
    spark.range(5).select(F.col("id").cast("double").alias("a")).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("a double").parquet(str(tmp_path / "in"))
    out, _ = rules.apply_rules(stream, [{"type": "formula", "output_col": "o", "expression": "a * 2"}], strict=True)
    q = out.writeStream.format("memory").queryName("rules_out").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(r["o"] for r in spark.table("rules_out").collect()) == [0.0, 2.0, 4.0, 6.0, 8.0]
