"""Learnt operators on edge cases, and their parts by hand."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from studyspark.llm.langid import UNKNOWN, fit_languages, forward_backward, identify_languages, label_text
from studyspark.llm.quality import fourier, isotonic, score_quality
from studyspark.llm.toxicity import HITS, VOTERS, Lexicon, count_hits, drop_toxic, fit_label_model, score_toxicity
from studyspark.llm.wordbytes import chunks


@pytest.mark.parametrize("score", [score_quality, score_toxicity])
def test_scores_on_edges(edge, empty, labels, no_labels, score):
    got = score(edge, labels).collect()
    assert len(got) == edge.count()
    assert all(0 <= r["score"] <= 1 for r in got)
    assert score(edge, no_labels).count() == edge.count()
    assert score(empty, labels).count() == 0


def test_capitals_of_all_alphabets_hit_the_lexicon(spark):
    known = Lexicon({**{k: [] for k in HITS[:7]}, "word_a": ["écrasé", "дурак"], "prefix": ["ñoño"]})
    texts = ["Écrasé", "ÉCRASÉ дурак", "Дурак!", "ДУРАК ÑOÑOS", None, "x", "ABCD"]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string").coalesce(1)
    got = {r["id"]: r["h"] for r in df.select("id", count_hits(F.col("text"), known).alias("h")).collect()}
    assert [got[k][HITS.index("word_a")] for k in range(7)] == [1, 2, 1, 1, 0, 0, 0]
    assert got[3][HITS.index("prefix")] == 1
    assert [got[k][HITS.index("shout")] for k in range(7)] == [0, 0, 0, 0, 0, 0, 1]


def test_toxic_rows_go_whole(edge, labels, spark):
    assert drop_toxic(edge, labels).columns == edge.columns
    bad = spark.createDataFrame([(1, "you stupid idiot, such scum and trash"), (2, "a fine day")], "doc_id int, text string")
    none = labels.limit(0)
    assert [r["doc_id"] for r in drop_toxic(bad, none).collect()] == [2]


def test_languages_on_edges(edge, empty):
    got = identify_languages(edge).collect()
    assert len(got) == edge.count()
    blank = [r for r in got if r["doc_id"] in (0, 1, 2, 8)]
    assert all(r["lang_pred"] == UNKNOWN and r["score"] == 0.0 for r in blank)
    assert identify_languages(empty).count() == 0


def test_switched_text_is_labelled_by_word(spark, data):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    known = docs.where("lang in ('en', 'de')").selectExpr("doc_id AS id", "text", "lang")
    model = fit_languages(known)
    text = "The there with and thing. Der und schlich die einung auf der keit. This thered of the and"
    labels = [lang for _, lang, _ in label_text(model, text)]
    assert labels[:5] == ["en"] * 5 and labels[-5:] == ["en"] * 5
    assert labels[6:12].count("de") >= 5


def test_forward_backward_sums_over_all_paths():
    draw = np.random.default_rng(0)
    score, step = draw.normal(size=(7, 3)), draw.normal(size=(3, 3))
    first, length = np.array([0, 4]), np.array([4, 3])
    p, expected = forward_backward(score, step, first, length)
    want, turns = np.zeros((7, 3)), np.zeros((3, 3))
    for f, n in zip(first, length, strict=True):
        total, own, own_turns = 0.0, np.zeros((n, 3)), np.zeros((3, 3))
        for path in np.ndindex(*[3] * n):
            w = np.exp(sum(score[f + t, y] for t, y in enumerate(path)) + sum(step[a, b] for a, b in zip(path, path[1:], strict=False)))
            total += w
            for t, y in enumerate(path):
                own[t, y] += w
            for a, b in zip(path, path[1:], strict=False):
                own_turns[a, b] += w
        want[f : f + n] = own / total
        turns += own_turns / total
    assert np.allclose(p, want) and np.allclose(expected, turns)


def test_fourier_features_approximate_the_kernel():
    x = np.random.default_rng(1).normal(size=(30, 23))
    z = fourier(x)[:, 1:]
    from studyspark.llm.quality import WIDTH

    gap = ((x[:, None] - x[None]) ** 2).sum(axis=2)
    assert np.abs(z @ z.T - np.exp(-gap / (2 * WIDTH**2))).mean() < 0.08


def test_isotonic_pools_violators():
    at, level = isotonic(np.arange(5.0), np.array([0, 1, 0, 1, 1.0]), np.ones(5))
    assert list(level) == [0, 0.5, 1] or list(level) == [0, 0.5, 1, 1]
    assert np.all(np.diff(level) >= 0) and np.all(np.diff(at) > 0)


def test_label_model_recovers_accuracies():
    """Voters drawn from known rates; EM without labels finds them and the tie of two of them."""
    draw = np.random.default_rng(2)
    n, m = 40_000, len(VOTERS)
    y = draw.random(n) < 0.2
    high, low = np.linspace(0.9, 0.6, m), np.full(m, 0.05)
    votes = draw.random((n, m)) < np.where(y[:, None], high, low)
    votes[:, 1] = np.where(draw.random(n) < 0.8, votes[:, 0], votes[:, 1])
    masks, counts = np.unique(votes @ (1 << np.arange(m)), return_counts=True)
    model = fit_label_model(masks, counts.astype(float), np.zeros((len(masks), 2)))
    assert abs(model.prior - 0.2) < 0.02
    assert 0 in (model.parent[1], 1 - model.parent[0] if model.parent[0] >= 0 else -9)
    right = (model.posterior(votes) > 0.5) == y
    assert right.mean() > 0.98


def test_chunks_keep_every_text_whole():
    texts = pa.array(["ab", None, "", "x" * 50, "é"] * 3).slice(1)
    out = []
    for c in chunks(texts, 10):
        out += [bytes(c.data[a:b]).decode() for a, b in zip(c.begin, c.end, strict=True)]
    assert out == [t or "" for t in texts.to_pylist()]
