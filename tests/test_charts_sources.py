import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from studyspark.catalog.deriving import write_lines
from studyspark.operators import charts, qc
from studyspark.plans.report import insight_facts
from studyspark.operators.rules import load_config
from studyspark.plans.study import run_study
from studyspark.sources import delimited, sinks


def test_histogram_counts_match_numpy(spark):
    x = np.round(np.random.default_rng(2).normal(size=500), 3)
    df = spark.createDataFrame([(float(v),) for v in x], "x double")
    got = charts.histogram(df, "x", bins=30).orderBy("bin").collect()
    want, edges = np.histogram(x, 30)
    assert [r["n"] for r in got] == list(want)
    assert [r["bin_low"] for r in got] == pytest.approx(list(edges[:-1]))


def test_histogram_of_a_constant(spark):
    df = spark.createDataFrame([("a", 2.0)] * 3 + [("b", 1.0), ("b", 3.0), (None, 9.0), ("c", None)], "g string, x double")
    got = charts.histogram(df.where("g = 'a'"), "x", bins=4).orderBy("bin").collect()
    assert [r["n"] for r in got] == [0, 0, 3, 0] and got[0]["bin_low"] == 1.5
    per = charts.histogram(df, "x", "g", bins=2).orderBy("g", "bin").collect()
    assert [(r["g"], r["n"]) for r in per] == [("a", 0), ("a", 3), ("b", 1), ("b", 1)]


def test_box(spark):
    df = spark.createDataFrame([(float(v),) for v in [1, 2, 3, 4, 5, 6, 7, 8, 9, 100]], "x double")
    r = charts.box_stats(df, ["x", "absent"]).first()
    assert (r["q1"], r["median"], r["q3"]) == (3.25, 5.5, 7.75)
    assert (r["whisker_low"], r["whisker_high"], r["n_fliers"]) == (1.0, 9.0, 1)
    assert [f["value"] for f in charts.fliers(df, ["x"]).collect()] == [100.0]


def test_header_lines_stand_on_each_partition(spark, tmp_path):
    heads = ["ID,Vel,Step,,Stride,", ",,Mean,SD,Mean,SD"]
    lines = spark.range(0, 1000, 1, 5).select(F.concat_ws(",", "id", *["id"] * 5).alias("value"))
    write_lines(lines, heads, str(tmp_path / "some"))
    files = [f.read_text().splitlines() for f in (tmp_path / "some").glob("part-*")]
    assert len(files) == 6 and all(f[:2] == heads for f in files)
    assert sorted(len(f) for f in files) == [2] + [202] * 5
    rows, _ = delimited.read_study(spark, [str(tmp_path / "some")])
    assert rows.agg(F.count("*"), F.sum("stride_sd")).first() == (1000, 499500)
    write_lines(lines.where("value = ''"), heads, str(tmp_path / "none"))
    rows, _ = delimited.read_study(spark, [str(tmp_path / "none")])
    assert rows.count() == 0 and "stride_sd" in rows.columns


def test_trend_takes_first_entities(spark):
    rows = [(0, "z", 0.0, 1.0, None), (1, "a", 0.0, 2.0, "g1"), (2, "z", 1.0, 3.0, "g2"), (3, "a", None, 1.0, "g1"), (4, "b", 0.0, 0.0, "g"), (5, "b", 1.0, 0.0, "g")]
    df = spark.createDataFrame(rows, "id int, e string, t double, y double, g string")
    got = charts.trend_series(df, "e", "t", "y", "id", "g", max_entities=2).collect()
    assert {(r["e"], r["group"]) for r in got} == {("z", "g2")} and len(got) == 2


def write(path, text):
    with open(path, "w") as f:
        f.write(text)
    return str(path)


def test_long_rows_are_kept_aside(spark, tmp_path):
    path = write(tmp_path / "m.csv", 'a,b,c\n1,2,3\n4,5\n6,7,8,9\n5,"q,r",7\n')
    got = delimited.read_delimited(spark, path)
    assert sorted(map(tuple, got.rows.drop("_source_file").collect())) == [("1", "2", "3"), ("4", "5", None), ("5", "q,r", "7")]
    assert [r["line"] for r in got.rejects.collect()] == ["6,7,8,9"]
    assert got.rows.select("a").count() == 3 and got.rows.select("c").where("c = '7'").count() == 1


GAIT = "ID,Vel,Step,,,Stride,\n,,Mean,SD,%CV,Mean,SD\n1,2,3,4,5,6,7\n2,2.5,3,4,5,6,8\n"


def test_two_row_header(spark, tmp_path):
    got = delimited.read_delimited(spark, write(tmp_path / "g.csv", GAIT))
    assert got.two_row_header
    assert got.rows.drop("_source_file").columns == ["id", "vel", "step_mean", "step_sd", "step_cv", "stride_mean", "stride_sd"]
    assert got.rows.count() == 2
    assert not delimited.is_sub_header(["Mean", "SD", "max", "x"])


def test_several_files(spark, tmp_path):
    a = write(tmp_path / "a.csv", "id,v\n1,2\n2,3\n")
    b = write(tmp_path / "b.csv", "id,v,extra\n1,x,7\n2,y,8\n9,9,9,9\n")
    rows, rejects = delimited.read_study(spark, [a, b])
    assert rows.columns == ["id", "v", "extra", "_source_file"]
    assert rows.count() == 4 and rejects.first()["_source_file"] == "b.csv"
    assert dict(rows.dtypes)["v"] == "string" and dict(rows.dtypes)["id"] == "bigint"
    ids = delimited.with_row_id(rows, str(tmp_path / "out"))
    assert ids.select("_row_id").distinct().count() == 4


def test_report_without_qc(spark):
    d = spark.createDataFrame([("x", 1.0, 2.0, 1.5, 0.0)], "column string, mean double, sd double, median double, missing_pct double")
    facts = insight_facts(None, d).collect()
    assert [r["value"] for r in facts if r["section"] == "qc"] == [None] * 4
    assert any(r["section"] == "limitations" for r in facts)


def test_study_end_to_end(spark, tmp_path):
    rows = [(i, f"p{i % 12}", f"2024-{1 + i // 12:02d}-{1 + i % 12:02d}", "off" if i % 2 else "on", float(i % 12) + (i // 12) * 0.5 + i % 2, "yes" if i % 3 else "no") for i in range(96)]
    df = spark.createDataFrame(rows, "_row_id int, patient_id string, visit_date string, arm string, score double, medtext string")
    config = {
        "entity_id": "patient_id", "time_col": "visit_date", "group_col": "arm", "outcome_col": "score",
        "rules": [
            {"type": "keyword_map", "source_col": "medtext", "output_col": "med", "mappings": [{"keywords": ["y"], "label": "MED"}]},
            {"type": "formula", "output_col": "double_score", "expression": "score * 2"},
            {"type": "formula", "output_col": "bad", "expression": "nope + 1"},
        ],
        "duplicate_keys": ["patient_id", "visit_date"], "group_cols": ["med"],
        "model": {"task": "classification", "target": "arm", "features": ["score", "double_score"], "trees": 5, "depth": 3, "repeats": 1},
    }
    out = run_study(df, config, ["_row_id"])
    assert len(out["rule_issues"]) == 1
    assert out["qc"].count() == 96 and out["qc_totals"].first()["kept"] == 96
    assert out["slopes"].count() == 12 and {"compare_arm", "compare_med"} <= set(out)
    assert out["model"].error is None
    folder = str(tmp_path / "study")
    sinks.write_study(out, folder, config)
    text = [r[0] for r in spark.read.text(f"{folder}/insights_report").collect()]
    assert "## compare" in text and any(t.startswith("- score: effect=") for t in text)
    assert load_config(spark, f"{folder}/config")["group_col"] == "arm"
    assert spark.read.parquet(f"{folder}/qc_log").count() == 96
    assert sorted(os.listdir(f"{folder}/plots"))
    assert spark.read.parquet(f"{folder}/predictions_random_forest").count() == out["model"].summary["n_test"]


def test_writers(spark, tmp_path):
    df = qc.run_qc(spark.range(5).withColumn("x", F.when(F.col("id") > 0, F.col("id"))), required=["x"])
    sinks.write_kept(df, str(tmp_path))
    sinks.write_annotated(df, str(tmp_path))
    assert spark.read.option("header", True).csv(str(tmp_path / "kept")).count() == 4
    assert spark.read.option("header", True).csv(str(tmp_path / "cleaned_qc_dataset")).count() == 5


def test_long_quoted_list_in_a_short_row(spark, tmp_path):
    taps = ", ".join(str(k) for k in range(10_000))
    (tmp_path / "a.csv").write_text(f'a,b,c\n1,"[{taps}]"\n2,x,y\n3,x,y,z\n')
    rows, rejects = delimited.read_study(spark, [str(tmp_path / "a.csv")])
    got = {r["a"]: r for r in rows.collect()}
    assert got[1]["b"] == f"[{taps}]" and got[1]["c"] is None and set(got) == {1, 2}
    assert [r["line"] for r in rejects.collect()] == ["3,x,y,z"]


def test_ids_stay_whole_and_files_keep_their_names(spark, tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "one.csv").write_text("id,v\n9007199254740992,1\n")
    (tmp_path / "d" / "two.csv").write_text("id,v\n9007199254740993,2.5\n")
    (tmp_path / "x.csv").write_text("id,w\n5,123456789012345678901234\n")
    rows, _ = delimited.read_study(spark, [str(tmp_path / "d"), str(tmp_path / "x.csv")])
    got = {(r["id"], r["v"], r["w"], r["_source_file"]) for r in rows.collect()}
    assert got == {
        (9007199254740992, 1.0, None, "one.csv"),
        (9007199254740993, 2.5, None, "two.csv"),
        (5, None, "123456789012345678901234", "x.csv"),
    }
