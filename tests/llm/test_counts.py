"""Repetition, mixing and license scans against plain Python."""

import re

import pytest
from pyspark.sql import functions as F

from studyspark.llm.licenses import scan_licenses
from studyspark.llm.mixing import mix_sources, source_targets
from studyspark.llm.repetition import judge_repetition, measure_repetition

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def _repetition(text):
    words = WORD.findall(text or "")
    grams = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    hit = set()
    for i, g in enumerate(grams):
        if grams.count(g) > 1:
            hit |= set(range(i, i + 5))
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return (
        len(words),
        sum(map(len, words)),
        len(re.findall(r"[#*$%&|<>]", text or "")),
        len(lines) - len(set(lines)),
        len(hit),
    )


def test_repetition_by_hand(spark):
    texts = [None, "", "a b c d e f a b c d e", "x\nx \nx\n\n", "é|é *é* z", "a a a a a a a a a a a a"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    got = {r[0]: tuple(r[1:6]) for r in measure_repetition(df).collect()}
    assert got == {i: _repetition(t) for i, t in enumerate(texts)}


def test_repetition_edges(spark, edge, empty):
    found = judge_repetition(measure_repetition(edge)).collect()
    assert len(found) == edge.count()
    assert all(r["base_failed"] and not r["kept"] for r in found if r["n_words"] < 10)
    assert sum(r["kept"] for r in found) == 5
    assert measure_repetition(empty).count() == 0


def test_mix_is_exact_and_repeats(spark, edge, empty):
    rows = [(i, " ".join(["w"] * (1 + i % 7)), ["a", "b", None][i % 3], "x") for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id int, text string, source string, size string")
    one = {r["row"]["doc_id"]: r for r in mix_sources(df).collect()}
    two = {r["row"]["doc_id"]: r for r in mix_sources(df.repartition(5)).collect()}
    assert one == two
    for s in ("a", "b", None):
        part = [r for r in one.values() if r["row"]["source"] == s]
        assert sum(r["taken"] for r in part) == int(part[0]["target"] + 1e-6)
        assert all(0 <= r["taken"] <= 2 * r["size"] for r in part)
    assert mix_sources(edge).count() == edge.count()
    assert mix_sources(edge).where("size = 0 and taken > 0").count() == 0
    assert mix_sources(empty).count() == 0


def test_targets_reshare_the_excess(spark):
    sizes = spark.createDataFrame([("a", 10), ("b", 1000), (None, 100)], "source string, source_size bigint")
    got = {r[0]: r[2] for r in source_targets(sizes, (3, 1, 2), 1.5, 2).collect()}
    assert got["a"] == 20 and got[None] == 200 and got["b"] == pytest.approx(1665 - 220)


def test_license_places(spark, edge, empty):
    texts = [
        "MIT License, mit-license! The Apache License.",
        "cc by; CC BY-NC and GNU general public License",
        "Permission is hereby granted, free of charge, to any person obtaining copy of this software and "
        "associated documentation files, to deal in the software without restriction",
        "mit licence apache-licenses",
        "mit Kicense mit",
        None,
    ]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    got = {r["doc_id"]: r for r in scan_licenses(df).collect()}
    assert [got[0][k] for k in ("n_words", "n_base", "first_word", "last_word", "base_labels")] == [7, 3, 0, 5, "apache,mit"]
    assert (got[1]["n_base"], got[1]["base_labels"], got[1]["labels"]) == (3, "cc-by,gpl", "cc-by,cc-by-nc,gpl")
    assert (got[2]["n_base"], got[2]["labels"]) == (0, "mit") and got[2]["score"] >= 0.7
    assert got[3]["labels"] == "" and got[4]["n_base"] == 0
    assert (got[5]["n_words"], got[5]["first_word"], got[5]["score"]) == (0, None, 0.0)
    assert scan_licenses(edge).count() == edge.count()
    assert scan_licenses(empty).count() == 0
    assert scan_licenses(df.union(df).where(F.col("doc_id") == 0)).count() == 2
