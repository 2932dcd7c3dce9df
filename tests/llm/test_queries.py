"""Text queries with SQL give the SQL's rows; the learnt ones are accurate on held-out rows."""

import glob
import math
import os

import duckdb
import pytest

import studyspark.llm.catalog  # noqa: F401
from studyspark.llm.base import REGISTRY, table

SF = "/root/testdata/sf0.01"


def _canon(rows, cols):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    out = []
    for r in rows:
        cells = [r[i] for i in order]
        out.append(tuple(None if isinstance(v, float) and math.isnan(v) else round(v, 6) if isinstance(v, float) else v for v in cells))
    return sorted(out, key=repr)


@pytest.fixture(scope="module")
def duck(data):
    con = duckdb.connect()
    for f in glob.glob(f"{data}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


@pytest.mark.parametrize("name", [n for n, q in REGISTRY.items() if q.sql])
def test_matches_sql(spark, data, duck, name):
    df = REGISTRY[name].run(spark, data)
    got = [tuple(r) for r in df.collect()]
    cur = duck.execute(REGISTRY[name].sql)
    cols = [c[0] for c in cur.description]
    assert sorted(cols) == sorted(df.columns)
    assert _canon(got, df.columns) == _canon(cur.fetchall(), cols)


def _auc(good, bad):
    return sum((g > b) + 0.5 * (g == b) for g in good for b in bad) / (len(good) * len(bad))


@pytest.mark.parametrize(
    "name,label,least", [("op3_quality_classifier", "quality", 0.97), ("op5_toxicity", "toxic", 0.8)]
)
def test_held_out_scores(spark, name, label, least):
    scored = REGISTRY[name].run(spark, SF)
    known = table(spark, SF, "labels")
    rows = scored.join(known, "doc_id").where("held_out").collect()
    assert scored.count() == table(spark, SF, "documents").count()
    good = [r["score"] for r in rows if r[label] == 1]
    bad = [r["score"] for r in rows if r[label] == 0]
    assert _auc(good, bad) >= least
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in rows)


def test_held_out_languages(spark):
    found = REGISTRY["op9_language_id"].run(spark, SF)
    rows = found.join(table(spark, SF, "documents").select("doc_id", "lang"), "doc_id").collect()
    assert len(rows) == table(spark, SF, "documents").count()
    held = [r for r in rows if r["held_out"]]
    assert sum(r["lang"] == r["lang_pred"] for r in held) >= 0.98 * len(held)
